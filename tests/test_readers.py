"""Readers that work on names, paths and files."""

import pytest

from sitesift.sources import tables as tb


def test_columns_are_found_by_normalised_name():
    have = ["Unit Code", "Installed Capacity (MW)", "County"]
    assert tb.find_column(have, "unit_code") == "Unit Code" and tb.find_column(have, "Installed Capacity") == "Installed Capacity (MW)"
    assert tb.find_column(have, "fuel") is None
    with pytest.raises(KeyError, match="fuel"):
        tb.find_column(have, "fuel", required=True)


def test_a_zip_beside_its_table_is_left_out():
    assert tb.skip_zipped_twins(["a/x.csv", "a/x.zip", "a/y.zip", "a/Z.CSV", "a/Z.zip"]) == ["a/Z.CSV", "a/x.csv", "a/y.zip"]


def test_pipe_table_in_latin_one(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes("id|name|n\n1|Peñasco|3\n2|\"open quote|4\n3|a|b|c|5\n".encode("latin-1"))
    rows = tb.pipe_table(spark, str(tmp_path / "t.txt"), ["id", "name"]).collect()
    assert [(r.id, r["name"]) for r in rows] == [("1", "Peñasco"), ("2", "\"open quote")]


def test_missing_columns_are_named(spark):
    with pytest.raises(KeyError, match="p_state"):
        tb.require_columns(spark.range(1).toDF("EIA_ID"), ["eia_id", "p_state"])
    with pytest.raises(KeyError):
        tb.union_sheets({"notes": spark.range(1).toDF("text")}, "Unit Code", "fuel", ["SOLAR"])


def test_line_sources(spark):
    lines = spark.createDataFrame([(1, "a", "345", None), (2, "b", "-999999", "100-161"), (3, "c", "-999999", "NOT AVAILABLE")], "line_id long, owner string, voltage string, volt_class string")
    assert [(r.line_id, r.kv, r.source) for r in tb.line_source(lines, lines, "map", "utility").orderBy("line_id").collect()] == [(1, 345.0, "utility"), (2, 138.0, "utility")]
    assert tb.line_source(lines, None, "map", "utility").filter("source = 'map'").count() == 3


def test_zips_beside_their_table_leave_a_listing(spark):
    listed = spark.createDataFrame([(p,) for p in ["a/x.csv", "a/x.zip", "a/y.zip", "a/Z.CSV", "a/Z.zip", "b/x.zip", "zip", "", None, "a/x.zip"]], "path string")
    assert sorted(r.path or "" for r in tb.without_zipped_twins(listed).collect()) == sorted(["a/x.csv", "a/y.zip", "a/Z.CSV", "b/x.zip", "zip", "", ""])
