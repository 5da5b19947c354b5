"""Replaying day files through the stream gives the batch result, and a redelivered day replaces itself."""

from pyspark.sql import functions as F

from sitesift.config import config
from sitesift.operators.settlement import interval_energy, pv_telemetry
from sitesift.sources.publish import changed_since, current, drop_stale_runs, manifest, pointers, publish, write_layer
from sitesift.streaming.settlement_stream import settle_days
from tests.test_market import runs


def test_stream_equals_batch(spark, tmp_path):
    cfg = config()
    day = lambda d, out: runs(spark, stamps=[f"07/{d}/2026 12:{m:02d}:00" for m in range(0, 60, 5)], tno=out)
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    day("15", 80.0).coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    settle_days(spark, src, schema, out, ck, cfg).awaitTermination(90)
    day("16", 60.0).union(day("15", 40.0)).coalesce(1).write.mode("append").parquet(src)
    settle_days(spark, src, schema, out, ck, cfg).awaitTermination(90)
    want = interval_energy(pv_telemetry(day("16", 60.0).union(day("15", 40.0)), cfg), cfg)
    pick = lambda df: sorted((str(r[0]), round(r[1], 6)) for r in df.select(F.to_date("operating_day"), "gen_mwh").collect())
    assert pick(spark.read.parquet(out)) == pick(want)


def test_one_day_in_two_triggers(spark, tmp_path):
    """Noon rows in one batch, later rows in the next, then a correction and a repeat: always what one batch of all gives."""
    cfg = config()
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    part = lambda hour, tno, unit="S": runs(spark, unit, tno, stamps=[f"07/15/2026 {hour}:{m:02d}:00" for m in range(0, 60, 5)])
    pick = lambda df: sorted((r[0], str(r[1]), round(r[2], 6)) for r in df.select("resource_name", "interval_start", "gen_mwh").collect())
    send = lambda df: (df.coalesce(1).write.mode("append").parquet(src), settle_days(spark, src, df.schema, out, ck, cfg).awaitTermination(90))
    batch = lambda df: interval_energy(pv_telemetry(df, cfg), cfg)
    send(part("12", 80.0))
    send(part("15", 80.0).union(part("12", 10.0, "T")))
    assert pick(spark.read.parquet(out)) == pick(batch(part("12", 80.0).union(part("15", 80.0)).union(part("12", 10.0, "T"))))
    send(part("12", 50.0))
    want = pick(batch(part("12", 50.0).union(part("15", 80.0)).union(part("12", 10.0, "T"))))
    assert pick(spark.read.parquet(out)) == want
    files = lambda: sorted(p.name for p in (tmp_path / "out").rglob("part-*"))
    before = files()
    send(part("15", 80.0))
    assert pick(spark.read.parquet(out)) == want and files() == before


def test_a_batch_reads_its_own_days_alone(spark, tmp_path):
    """The stored rows of another day are made unreadable; batches of other days settle all the same, and a repeat of a day's
    latest delivery does not open the earlier ones either."""
    cfg = config()
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    part = lambda day, hour, tno=80.0: runs(spark, "S", tno, stamps=[f"07/{day}/2026 {hour}:{m:02d}:00" for m in range(0, 60, 5)])
    send = lambda df: (df.coalesce(1).write.mode("append").parquet(src), settle_days(spark, src, df.schema, out, ck, cfg).awaitTermination(90))
    spoil = lambda pattern: [p.write_bytes(b"not a table") for p in (tmp_path / "out_rows").glob(pattern)]
    files = lambda: sorted(p.name for p in (tmp_path / "out").rglob("part-*"))
    total = lambda: sorted((str(r[0]), round(r[1], 6)) for r in spark.read.parquet(out).groupBy("operating_day").agg(F.sum("hours")).collect())
    send(part("15", "12"))
    assert spoil("operating_day=2026-07-15/batch=0/*.parquet") and spoil("operating_day=2026-07-15/batch=0/.*.crc")
    send(part("16", "12"))
    send(part("16", "13"))
    assert total() == [("2026-07-15", 1.0), ("2026-07-16", 2.0)]
    assert spoil("operating_day=2026-07-16/batch=1/*.parquet") and spoil("operating_day=2026-07-16/batch=1/.*.crc")
    before = files()
    send(part("16", "13").orderBy(F.col("sced_time_stamp").desc()))
    assert files() == before


def test_a_repeat_behind_a_correction_counts(spark, tmp_path):
    """Delivery A, its correction B, then A again: the rows that came last count, though A is not new."""
    cfg = config()
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    part = lambda tno: runs(spark, "S", tno, stamps=[f"07/15/2026 12:{m:02d}:00" for m in range(0, 60, 5)])
    send = lambda df: (df.coalesce(1).write.mode("append").parquet(src), settle_days(spark, src, df.schema, out, ck, cfg).awaitTermination(90))
    seen = lambda: round(spark.read.parquet(out).agg(F.sum("gen_mwh")).first()[0], 6)
    send(part(80.0)), send(part(50.0))
    assert seen() == 50.0
    send(part(80.0))
    assert seen() == 80.0
    send(runs(spark, "S", 1.0, stamps=["07/15/2026 12:00:00"]).withColumn("resource_type", F.lit("WIND")))
    assert seen() == 80.0
    send(part(50.0))
    assert seen() == 50.0


def test_publish_moves_only_after_the_check(spark, tmp_path):
    path = str(tmp_path / "t")
    publish(spark.range(5), path, "id", "r1")
    try:
        publish(spark.range(5).union(spark.range(2)), path, "id", "r2")
        raise AssertionError("duplicate keys were published")
    except ValueError:
        pass
    df = current(spark, path)
    assert df.count() == 5 and df.first().run_id == "r1"
    publish(spark.range(3), path, "id", "r3")
    assert current(spark, path).count() == 3 and [v for v, _ in pointers(spark, path)] == [1, 2]
    spark.range(1).write.parquet(f"{path}_pointers/version=000000009")
    (tmp_path / "t_pointers" / "version=000000009" / "_SUCCESS").unlink()
    assert current(spark, path).count() == 3
    assert drop_stale_runs(spark, path) >= 1 and current(spark, path).count() == 3


def test_manifest_tells_what_changed(spark, tmp_path):
    root = str(tmp_path)
    write_layer(spark.range(4), root, "a"), write_layer(spark.range(2), root, "b")
    stored = manifest(spark, root, ["layers/a.parquet", "layers/b.parquet"]).collect()
    stored = spark.createDataFrame(stored)
    write_layer(spark.range(1, 5), root, "a")
    now = manifest(spark, root, ["layers/a.parquet", "layers/b.parquet"])
    assert [r.name for r in changed_since(stored, now).collect()] == ["layers/a.parquet"]
