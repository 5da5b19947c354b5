"""Reading published tables: headers found by name, footnotes dropped, free text kept whole."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.nulls import blank_to_null, to_number
from ..functions.text import class_kv, header_key


def find_column(columns, *candidates: str, required: bool = False) -> str | None:
    """First column whose normalised name equals a candidate, else the first that starts with one."""
    by = {header_key(c): c for c in columns}
    for test in (lambda n, k: n == k, lambda n, k: n.startswith(k)):
        for cand in candidates:
            for n, c in by.items():
                if test(n, header_key(cand)):
                    return c
    if required:
        raise KeyError(f"none of {list(candidates)} among {list(columns)}")
    return None


def pick_attributes(df: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """Vendor columns renamed to the wanted attributes, null where a source has none."""
    exact = {header_key(c): c for c in df.columns}
    hit = {a: next((exact[header_key(k)] for k in cands if header_key(k) in exact), None) for a, cands in fields.items()}
    return df.select(*[(F.col(c) if c else F.lit(None).cast("string")).alias(a) for a, c in hit.items()])


def keyed_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is a number; text trimmed, blanks null."""
    texts = {c: blank_to_null(F.col(c)) for c, k in df.dtypes if k == "string" and c != key}
    return df.withColumn(key, to_number(F.col(key)).cast("bigint")).filter(F.col(key).isNotNull()).withColumns(texts)


def pipe_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Pipe-delimited Latin-1 text with a header, no quoting; rows with a surplus delimiter are dropped."""
    # without column pruning: a pruned reader would not see the surplus field
    df = spark.read.option("columnPruning", False).csv(path, sep="|", header=True, quote="", encoding="ISO-8859-1", mode="DROPMALFORMED")
    return df.select(*columns)


def split_limit(lines: DataFrame, value: str = "value") -> DataFrame:
    """id|x|top|bottom|description, where the description may hold the delimiter itself."""
    parts = F.split(F.col(value), r"\|", 5)
    return (lines.withColumn("_p", parts).filter(F.size("_p") == 5)
            .select(to_number(F.col("_p")[0]).cast("bigint").alias("id"), to_number(F.col("_p")[2]).alias("top_ft"),
                    to_number(F.col("_p")[3]).alias("bottom_ft"), F.col("_p")[4].alias("desc"))
            .filter("id is not null and top_ft is not null and bottom_ft is not null"))


def without_zipped_twins(files: DataFrame, path: str = "path") -> DataFrame:
    """Rows of a file listing without the zips whose CSV lies beside them: read together they would count twice."""
    is_csv, is_zip = (F.lower(F.col(path)).endswith(f".{kind}") for kind in ("csv", "zip"))
    stem = F.expr(f"left({path}, length({path}) - 4)")
    beside = files.filter(is_csv).select(stem.alias("_stem")).distinct()
    return files.withColumn("_stem", F.when(is_zip, stem)).join(beside, "_stem", "left_anti").drop("_stem")


def skip_zipped_twins(paths: list[str]) -> list[str]:
    """A zip is left out when its CSV lies beside it."""
    stems = {re.sub(r"\.csv$", "", p, flags=re.I) for p in paths if p.lower().endswith(".csv")}
    return sorted(p for p in paths if not (p.lower().endswith(".zip") and p[:-4] in stems))


def days_missing(days: DataFrame, start: str, end: str) -> DataFrame:
    """Days of [start, end] that a table of days does not hold."""
    spark = days.sparkSession
    span = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))
    return span.join(days.select("day").distinct(), "day", "left_anti")


def day_scan(df: DataFrame, start: str, end: str, resources: DataFrame | None = None) -> DataFrame:
    """Day partitions in range, optionally only the wanted resources; both reach the scan before any shuffle."""
    out = df.filter(F.col("operating_day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return out.join(resources, "resource_name", "left_semi") if resources is not None else out


def hand_table(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A hand-kept text table in a fixed column order: blanks null, absent columns null, numbers that cannot be read null."""
    have = set(raw.columns)
    text = lambda c: blank_to_null(F.col(c).cast("string"))
    return raw.select(*[((to_number(text(c)) if kind in ("double", "int", "bigint") else text(c)).cast(kind) if c in have else F.lit(None).cast(kind)).alias(c) for c, kind in columns.items()])


def union_sheets(sheets: dict[str, DataFrame], key: str, fuel: str, codes: list[str]) -> DataFrame:
    """Sheets that have the key column, their solar rows, each with the name of its sheet; absent columns null."""
    parts = [solar_rows(df, F.col(fuel), codes).withColumn("sheet", F.lit(name)) for name, df in sheets.items() if find_column(df.columns, key)]
    if not parts:
        raise KeyError(f"no sheet has a column {key}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def latest_snapshot(df: DataFrame, month: str) -> DataFrame:
    """Rows of the newest month a partitioned table holds; the month is one scalar, so the scan prunes to it."""
    return df.filter(F.col(month) == df.agg(F.max(month)).scalar())


def require_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Lower-cased names, or an error that names what was found."""
    out = df.toDF(*[c.lower() for c in df.columns])
    absent = [c for c in wanted if c not in out.columns]
    if absent:
        raise KeyError(f"columns {absent} are missing; found {sorted(out.columns)}")
    return out


def days_to_read_again(needed: DataFrame, recorded: DataFrame, days: DataFrame) -> DataFrame:
    """All price days where some needed location was never recorded, none otherwise."""
    absent = needed.select("location").distinct().join(recorded.select("location").distinct(), "location", "left_anti")
    return days.select("day").distinct().filter(absent.agg(F.count(F.lit(1)) > 0).scalar())


def line_source(map_lines: DataFrame, utility: DataFrame | None, label: str, utility_label: str) -> DataFrame:
    """Lines of the map, or of a utility file that replaces them: kV from its value or class, unknown kV left out, owner as
    the name."""
    if utility is None:
        return map_lines.withColumn("source", F.lit(label))
    return (utility.select("line_id", F.col("owner").alias("name"), class_kv(F.col("voltage"), F.col("volt_class")).alias("kv"))
            .filter("kv is not null").withColumn("source", F.lit(utility_label)))


def payload_rows(payloads: DataFrame, column: str, schema: str, field: str) -> DataFrame:
    """Stored JSON answers, one row per element of a list inside; answers that cannot be read give no row."""
    keep = [c for c in payloads.columns if c != column]
    return payloads.select(*keep, F.explode(F.from_json(column, schema)[field]).alias("_e")).select(*keep, "_e.*")


def solar_rows(df: DataFrame, fuel: Column, codes: list[str]) -> DataFrame:
    return df.filter(F.upper(fuel).rlike("|".join(codes)))
