"""Small readers, flags, parsers, bands and closed-form models, each on its own."""

from pyspark.sql import functions as F

from ..config import config
from ..functions import bands, text
from ..functions.calendar import parse_end
from ..functions.nulls import to_number, yes_flag
from ..functions.physics import soil_conductivity
from ..session import scratch_path
from ..sources import tables as tb
from .registry import query, view

CFG = config()

view("loose_text", """
SELECT event_id,
       CASE event_id % 7 WHEN 0 THEN concat(' ', CAST(event_id % 1000 AS STRING), '.5 ') WHEN 1 THEN 'n/a' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'NaN'
         WHEN 5 THEN concat('-', CAST(event_id % 90 + 1 AS STRING)) ELSE '1e3' END AS num,
       CASE event_id % 9 WHEN 0 THEN ' yes' WHEN 1 THEN 'Y' WHEN 2 THEN 'true ' WHEN 3 THEN '1' WHEN 4 THEN 'N' WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN 'yess' ELSE 'No' END AS flag,
       CASE event_id % 6 WHEN 0 THEN concat('built ', CAST(1950 + event_id % 70 AS STRING), ' and 2031') WHEN 1 THEN '3/15/1998' WHEN 2 THEN 'unknown' WHEN 3 THEN NULL WHEN 4 THEN '21999' ELSE '1899' END AS made,
       CASE event_id % 9 WHEN 0 THEN CAST(2020 + event_id % 40 AS STRING) WHEN 1 THEN '2031-07' WHEN 2 THEN '2032-02-29' WHEN 3 THEN '2031-02-30' WHEN 4 THEN 'soon' WHEN 5 THEN '2031-07-05T00:00'
         WHEN 6 THEN NULL WHEN 7 THEN '20x1' ELSE ' 2029-11 ' END AS until
FROM events
""")


@query("to_number", "SELECT event_id, CASE WHEN NOT isnan(v) THEN v END AS v FROM (SELECT event_id, TRY_CAST(trim(num) AS DOUBLE) AS v FROM loose_text) x")
def _(t):
    return t["loose_text"].select("event_id", to_number(F.col("num")).alias("v"))


@query("yes_flag", "SELECT event_id, coalesce(upper(trim(flag)) IN ('Y', 'YES', 'TRUE', '1'), false) AS flag FROM loose_text")
def _(t):
    return t["loose_text"].select("event_id", yes_flag(F.col("flag")).alias("flag"))


@query("year_of", r"SELECT event_id, TRY_CAST(regexp_extract(made, '(?:19|20)\d\d') AS INTEGER) AS year FROM loose_text")
def _(t):
    return t["loose_text"].select("event_id", text.year_of(F.col("made")).alias("year"))


@query("parse_end", """
SELECT event_id, TRY_CAST(CASE length(trim(until)) WHEN 4 THEN trim(until) || '-07-01' WHEN 7 THEN trim(until) || '-01' ELSE trim(until)[1:10] END AS DATE) AS ends FROM loose_text
""")
def _(t):
    return t["loose_text"].select("event_id", parse_end(F.col("until"), CFG["offtake"]["year_only_end_month"]).alias("ends"))


view("utility_tags", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN -999999 WHEN 1 THEN 345 WHEN 2 THEN NULL ELSE 0 END AS voltage,
       CASE c_nationkey % 7 WHEN 0 THEN '220-287' WHEN 1 THEN '100-161' WHEN 2 THEN 'DC' WHEN 3 THEN '345' WHEN 4 THEN 'NOT AVAILABLE' WHEN 5 THEN '735 AND ABOVE' ELSE NULL END AS volt_class
FROM customer
""")


@query("hifld_kv", r"""
SELECT c_custkey, CASE WHEN voltage > 0 THEN voltage WHEN top = 287 THEN 230 WHEN top = 161 THEN 138 ELSE top END::DOUBLE AS kv
FROM (SELECT *, list_max([CAST(x AS INTEGER) FOR x IN regexp_extract_all(volt_class, '\d+')]) AS top FROM utility_tags) u
""")
def _(t):
    return t["utility_tags"].select("c_custkey", text.class_kv(F.col("voltage"), F.col("volt_class")).alias("kv"))


@query("lambda_cote_konrad", """
SELECT mukey, cokey, hzdept_r, hzdepb_r, round((sat - dry) * (k * sr / (1 + (k - 1) * sr)) + dry, 5) AS moist, round(dry, 5) AS dry, round(sat, 5) AS sat
FROM (SELECT *, pow(pow(7.7e0, q) * pow(CASE WHEN q > 0.2e0 THEN 2e0 ELSE 3e0 END, 1 - q), 1 - n) * pow(0.6e0, n) AS sat, 0.75e0 * pow(10e0, -1.2e0 * n) AS dry,
        CASE WHEN n IS NOT NULL THEN greatest(0e0, least(1e0, wthirdbar_r / 100e0 / n)) END AS sr, CASE WHEN q * 100 >= 50 THEN 3.55e0 ELSE 1.9e0 END AS k
      FROM (SELECT *, sandtotal_r / 100e0 AS q, CASE WHEN dbthirdbar_r IS NOT NULL THEN greatest(0.05e0, least(0.95e0, 1e0 - dbthirdbar_r / 2.65e0)) END AS n FROM horizons) a) b
""")
def _(t):
    got = soil_conductivity(F.col("sandtotal_r"), F.col("dbthirdbar_r"), F.col("wthirdbar_r"), CFG["layers"]["soils"]["model"])
    return t["horizons"].select("mukey", "cokey", "hzdept_r", "hzdepb_r", *[F.round(c, 5).alias(k) for k, c in got.items()])


view("banded_in", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size / 2e0 END AS v FROM part")


@query("band", """
SELECT p_partkey, CASE WHEN v IS NULL THEN NULL WHEN v < 5 THEN 5 WHEN v < 15 THEN 2 ELSE 0 END::DOUBLE AS near, CASE WHEN v IS NULL THEN NULL WHEN v > 14 THEN 8 WHEN v > 10 THEN 6 WHEN v > 7 THEN 3 ELSE 0 END::DOUBLE AS room
FROM banded_in
""")
def _(t):
    return t["banded_in"].select("p_partkey", *[bands.band(F.col("v"), CFG["scoring"][k]["bands"]).alias(name) for name, k in (("near", "dist_345"), ("room", "acres"))])


view("spots", "SELECT s_suppkey, 26e0 + (s_suppkey * 104729 % 10000) / 1000e0 AS lat, -106e0 + (s_suppkey * 7919 % 12000) / 1000e0 AS lon FROM supplier")


@query("region_of", "SELECT s_suppkey, CASE WHEN lon < -100 THEN 'west_texas' WHEN lat < 30 AND lon > -99.5 THEN 'coastal' ELSE 'central_texas' END AS region FROM spots")
def _(t):
    return t["spots"].select("s_suppkey", bands.region_of(F.col("lat"), F.col("lon"), CFG["benchmarks"]).alias("region"))


@query("exists", """
SELECT l_orderkey, CASE WHEN max(l_partkey) % 60 >= 10 THEN bool_or(abs(l_quantity - p) <= 0.05e0 * p) END AS seen
FROM (SELECT *, max(l_partkey) OVER (PARTITION BY l_orderkey) % 60 AS p FROM lineitem) l GROUP BY l_orderkey
""")
def _(t):
    got = t["lineitem"].groupBy("l_orderkey").agg(F.collect_set("l_quantity").alias("classes"), (F.max("l_partkey") % 60).alias("p"))
    return got.select("l_orderkey", F.when(F.col("p") >= 10, F.exists("classes", lambda x: F.abs(x - F.col("p")) <= 0.05 * F.col("p"))).alias("seen"))


@query("membership_filter", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')")
def _(t):
    wanted = t["part"].where(F.col("p_type") == "PROMO").select(F.col("p_partkey").alias("l_partkey"))
    return t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey").join(wanted, "l_partkey", "left_semi")


@query("find_column", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, CAST(NULL AS DOUBLE) AS missing FROM customer")
def _(t):
    df = t["customer"]
    found = {name: tb.find_column(df.columns, *cands) for name, cands in {"id": ("customer key", "C Custkey"), "name": ("C_NAME",), "balance": ("c acct",), "missing": ("c phone 2",)}.items()}
    return df.select(*[(F.col(c) if c else F.lit(None).cast("double")).alias(name) for name, c in found.items()])


@query("pipe_table_read", """
SELECT CAST(c_custkey AS VARCHAR) AS id, '"' || c_name || ' é' AS name FROM customer
""")
def _(t):
    path = scratch_path(t.spark, "pipe")
    rows = t["customer"].select(F.col("c_custkey").alias("id"), F.lit("x").alias("unused"), F.concat(F.lit('"'), "c_name", F.lit(" é")).alias("name"))
    rows.write.csv(path, sep="|", header=True, quote="", encoding="ISO-8859-1")
    return tb.pipe_table(t.spark, path, ["id", "name"])
