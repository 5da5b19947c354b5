"""Licence scan by diagonal voting.

Texts are split into words inside tasks; the rest is one Spark plan. Every run of two and of three words of every document is
hashed and joined to the places of the templates' runs. A hit votes for (document, template, diagonal), the diagonal being the
document's word minus the template's word. The votes of a diagonal are checked word by word, neighbouring diagonals (words put
in or left out) merge into spans, and a span counts when enough of its template's words stand in it: all of a short template's,
a share of a longer one's.

The templates are an argument held by the driver; only their runs, at most MOST_RUNS, are broadcast. Groups are spans of one
document, so no group grows with the corpus.
"""

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import row_key, utf8, written
from .words import LOWER, WORD_BYTES, word_spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: fixed phrases: their places are counted
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: further notices of well-known licences: only their labels are added
NOTICES = (
    ("agpl", "gnu affero general public license"),
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsl", "boost software license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("epl", "eclipse public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
            "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mpl", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: words of a run (a template of two words has runs of two); templates under WHOLE words must stand whole, others to a SHARE;
#: diagonals up to SLACK words apart are one span
RUN, WHOLE, SHARE, SLACK = 3, 10, 0.8, 4
MOST_RUNS = 100_000


def split_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rid, words) of every row: A-Z lower-cased words of the whole text and an empty word that closes it."""
    schema = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("words", pa.list_(pa.string()))])

    def run(batches):
        for b in batches:
            letters, sizes, ends = [], [], [0]
            for t in utf8(b, "text"):
                low = t.translate(LOWER)
                first, last = word_spans(low, WORD_BYTES)
                raw = np.frombuffer(low, np.uint8)
                letters.append(raw[WORD_BYTES[raw]])
                sizes += [last - first, np.zeros(1, np.int64)]
                ends.append(ends[-1] + len(first) + 1)
            at = np.zeros(ends[-1] + 1, np.int32)
            if sizes:
                np.cumsum(np.concatenate(sizes), out=at[1:])
            flat = pa.StringArray.from_buffers(ends[-1], pa.py_buffer(at.tobytes()), pa.py_buffer(np.concatenate(letters).tobytes() if letters else b""))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rid"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], schema=schema)

    base = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "id long, rid long, words array<string>")


def _run_hash(size: int) -> Column:
    """Of the `size` words from `pos` on."""
    return F.xxhash64(F.lit(size), *[F.get("words", F.col("pos") + k) for k in range(size)])


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """(template, label, base, words, size) from (label, phrase, counted); template 0 is the empty word that closes a text."""
    rows = [(0, "", False, [""])] + [(n, label, base, phrase.split()) for n, (label, phrase, base) in enumerate(templates, 1)]
    if any(len(r[3]) < 2 for r in rows[1:]) or sum(len(r[3]) for r in rows) > MOST_RUNS:
        raise ValueError(f"templates need two words each and {MOST_RUNS} runs together at most")
    table = spark.createDataFrame(rows, "template int, label string, base boolean, words array<string>")
    return table.withColumn("size", F.when(F.col("template") == 0, 2).otherwise(F.least(F.lit(RUN), F.size("words"))))


def votes(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rid, template, diagonal, places, window, copies): which of a template's runs stand on a diagonal, and the document's
    words there. Template 0 has one row a document, its diagonal being the document's number of words."""
    wanted = (templates.select("template", "words", "size", F.posexplode("words").alias("pos", "w")).where("pos + size <= size(words) OR template = 0")
              .select("template", F.col("pos").alias("place"), F.size("words").alias("length"), F.when(F.col("size") == 2, _run_hash(2)).otherwise(_run_hash(RUN)).alias("hash")))
    runs = (split_words(docs, id_col, text_col).select("id", "rid", "words", F.posexplode("words").alias("pos", "w"))
            .select("id", "rid", "words", "pos", F.explode(F.array(_run_hash(2), _run_hash(RUN))).alias("hash")))
    diagonal = F.col("pos") - F.col("place")
    from_ = F.greatest(diagonal, F.lit(0))
    hits = runs.join(F.broadcast(wanted), "hash").select("id", "rid", "template", diagonal.alias("diagonal"), "place", F.slice("words", from_ + 1, F.col("length") + diagonal - from_).alias("window"))
    return hits.groupBy("id", "rid", "template", "diagonal").agg(F.array_sort(F.collect_set("place")).alias("places"), F.first("window").alias("window"), F.count("*").alias("copies"))


def _checked(found: DataFrame, templates: DataFrame) -> DataFrame:
    """Diagonals with the places of runs that agree word for word."""
    named = found.where("template > 0").join(F.broadcast(templates), "template")
    lead = F.greatest(-F.col("diagonal"), F.lit(0))
    same = lambda p: F.slice("window", p - lead + 1, F.col("size")) == F.slice("words", p + 1, F.col("size"))
    return named.withColumn("places", F.filter("places", same)).where("size(places) > 0")


def spans(found: DataFrame, templates: DataFrame, slack: int = SLACK) -> DataFrame:
    """(id, rid, template, label, base, first_word, last_word, share): runs of neighbouring diagonals of one template in one
    document, with the share of the template's words that stand there. Phrases that are counted do not merge."""
    in_order = Window.partitionBy("id", "rid", "template").orderBy("diagonal")
    apart = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(in_order) > slack, F.lit(True))
    parts = _checked(found, templates).withColumn("span", F.sum(apart.cast("int")).over(in_order))
    words = F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("size") - 1)))
    each = parts.select("id", "rid", "template", "label", "base", "span", "diagonal", F.size("words").alias("length"), F.explode(words).alias("word"))
    at = F.col("diagonal") + F.col("word")
    whole = each.groupBy("id", "rid", "template", "label", "base", "span", "length").agg(F.count_distinct("word").alias("there"), F.min(at).alias("first_word"), F.max(at).alias("last_word"))
    return whole.select("id", "rid", "template", "label", "base", "first_word", "last_word", "length", (F.col("there") / F.col("length")).alias("share"))


def scanned(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, id_col: str = "doc_id", text_col: str = "text",
            share: float = SHARE, whole: int = WHOLE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    n_base counts the places where a phrase's words stand consecutively, first_word and last_word are the least and the
    greatest start. labels adds those of notices found; score is the greatest share of a template's words in one span, 0 without
    any. A null text is empty; rows with equal id and text are scanned together and repeat in the result.
    """
    templates = template_table(docs.sparkSession, [(a, b, True) for a, b in phrases] + [(a, b, False) for a, b in notices])
    found = written(votes(docs, templates, id_col, text_col), "votes")  # the scan is run once
    is_base = F.col("base") & (F.col("share") == 1)
    good = is_base | (~F.col("base") & (F.col("share") >= F.when(F.col("length") < whole, 1.0).otherwise(share)))
    of_docs = found.where("template = 0").select("id", "rid", F.col("diagonal").cast("long").alias("n_words"), "copies").alias("d")
    of_spans = spans(found, templates).groupBy("id", "rid").agg(
        F.count_if(is_base).alias("n_base"), F.min(F.when(is_base, F.col("first_word"))).cast("long").alias("first_word"), F.max(F.when(is_base, F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(good, F.col("label")))), ",").alias("labels"), F.round(F.max("share"), 6).alias("score")).alias("s")
    rows = of_docs.join(of_spans, (F.col("d.rid") == F.col("s.rid")) & F.col("d.id").eqNullSafe(F.col("s.id")), "left")
    return rows.select(F.col("d.id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                       F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
