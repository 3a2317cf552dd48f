"""More registered queries, each with its SQL: phone captures, packs in all shapes, and what becomes of rows that fit nowhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, units
from ..operators import align, project
from ..scratch import scratch
from ..sinks import parquet
from ..sources import catalog
from .catalogue import VOLTS, S, query, samples, table
from .orders import ORACLES, QUERIES
from .proofs import CODES

__all__ = ["ORACLES", "QUERIES"]

AMPERES = "CASE WHEN abs({x}) >= 10000 THEN {x} / 1e6 WHEN abs({x}) >= 100 THEN {x} / 1e3 ELSE {x} END"
CLAMPED = "greatest(0.0, least(100.0, {x}))"
PHONE = f"""{S}, x AS (SELECT _seq, k::DOUBLE AS k, CASE WHEN _seq % 3 <> 0 THEN 3000000.0 + k * 1000 ELSE 3000.0 + k END::DOUBLE AS raw_v,
 CASE _seq % 4 WHEN 0 THEN (k - 50) * 1000 WHEN 1 THEN CASE WHEN _seq % 8 <> 1 THEN k * 20000 END WHEN 2 THEN k * -30 END::DOUBLE AS raw_a,
 CASE WHEN _seq % 2 = 0 THEN k * 10 ELSE k * 3 END::DOUBLE AS raw_t, CASE WHEN _seq % 5 = 0 THEN 'Charging' ELSE coalesce(CASE _seq % 6 WHEN 1 THEN 'Unknown' WHEN 2 THEN 'Charging' WHEN 3 THEN 'Discharging' WHEN 4 THEN 'Not charging' WHEN 5 THEN 'Full' END, '0') END AS status FROM s),
y AS (SELECT *, {AMPERES.format(x="raw_a")} AS a FROM x)"""


@query(f"""WITH {PHONE} SELECT _seq, {VOLTS.format(x="raw_v")} AS voltage_volt, CASE lower(status) WHEN 'charging' THEN abs(a) WHEN 'discharging' THEN -abs(a) ELSE a END AS current_ampere,
 CASE WHEN abs(raw_t) > 100 THEN raw_t / 10 ELSE raw_t END AS surface_temperature_celsius, status AS charge_status, CASE WHEN _seq % 7 = 0 THEN {CLAMPED.format(x="k * 2")} ELSE {CLAMPED.format(x="k * 100 / 200")} END AS state_of_charge_percent FROM y""")
def phone_samples(spark, sf_dir):
    """Phone captures written and read back: files of the system first, the dump fills in what they lack or cannot tell."""
    k, q = F.col("k"), F.col("_seq")
    told = lambda c: c.cast("string")
    files = F.create_map(
        F.lit("voltage_now"), F.when(q % 3 != 0, told(k * 1000 + 3000000)), F.lit("current_now"), F.when(q % 4 == 0, told((k - 50) * 1000)), F.lit("current_avg"), F.when(q % 4 == 1, F.when(q % 8 == 1, "n/a").otherwise(told(k * 20000))),
        F.lit("status"), F.when(q % 5 == 0, " Charging ").when(q % 5 == 1, ""), F.lit("temp"), F.when(q % 2 == 0, told(k * 10)), F.lit("capacity"), F.when(q % 7 == 0, told(k * 2)),
    )
    files = F.map_filter(files, lambda _, v: v.isNotNull())  # a listing names what can be read
    dump = F.concat(F.lit("Current Battery Service state:\r\n  status: "), told(q % 6), F.lit("\n  voltage: "), told(k + 3000), F.lit("\n  temperature: "), told(k * 3), F.lit("\n level: "), told(k), F.lit("\n scale: 200"), F.when(q % 4 == 2, F.concat(F.lit("\n  current now: "), told(k * -30))).otherwise(""))
    path = scratch(spark, "phone")
    samples(spark, sf_dir).select(F.to_json(F.struct(dump.alias("dumpsys"), files.alias("sysfs"), q.alias("_seq"))).alias("value")).write.text(path)
    return catalog.phone(spark, path, include_soc=True)


@query(f"WITH {S} SELECT _seq, " + ", ".join(f"CASE WHEN k % 7 > {i} THEN k + {i}.5 END::DOUBLE AS cell_{i + 1}_voltage_volt" for i in range(6)) + " FROM s")
def flat_cell_columns(spark, sf_dir):
    """Cell voltages as columns, as many as any row has."""
    k = F.col("k")
    cells = F.transform(F.slice(F.array(*(F.lit(i) for i in range(6))), F.lit(1), (k % 7).cast("int")), lambda i: k + i + 0.5)
    return project.flat_cells(samples(spark, sf_dir).select("_seq", cells.alias("cell_voltages")))


@query(f"""WITH {S}, x AS (SELECT _seq, CASE WHEN k % 2 = 0 THEN '"design":"' || k || '"' END AS a, CASE WHEN k % 3 = 0 THEN '"maker":"' || run_id || '"' END AS b, CASE WHEN k % 5 = 0 THEN '"relative":"true"' END AS c FROM s)
SELECT _seq, '{{' || concat_ws(',', a, b, c) || '}}' AS facts FROM x""")
def pack_facts(spark, sf_dir):
    """Facts of a pack without those that it does not tell."""
    k = F.col("k")
    facts = project.non_null_map({"design": F.when(k % 2 == 0, k), "maker": F.when(k % 3 == 0, F.col("run_id")), "relative": F.when(k % 5 == 0, F.lit(True))})
    return samples(spark, sf_dir).select("_seq", F.to_json(facts).alias("facts"))


@query("""WITH l AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 4 <> 0 THEN lower(c_name) END AS key FROM customer),
r AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 5 <> 0 THEN lower(c_name) END AS key, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS v FROM customer)
SELECT l.pos, CASE WHEN l.key IS NULL THEN p.v ELSE r.v END AS number FROM l LEFT JOIN r ON l.key = r.key JOIN r p ON p.pos = l.pos""")
def looked_up_numbers(spark, sf_dir):
    """One number of the sibling row of each status row, by key, or by place for rows without a key; unknown numbers are null."""
    c = table(spark, sf_dir, "customer")
    key = lambda m: F.when(F.col("c_custkey") % m != 0, F.lower("c_name")).alias("key")
    pos = F.col("c_custkey").alias("pos")
    number = F.when(F.col("c_custkey") % 3 == 0, float(units.UNKNOWN_NUMBER)).otherwise(F.col("c_acctbal")).alias("number")
    out = align.align(c.select(pos, key(4)), c.select(pos, key(5), number), ["number"])
    return out.select("pos", units.known_number(F.col("number")).alias("number"))


@query("""SELECT o_custkey AS name, 'built in' AS maker, count(*)::BIGINT AS n FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1
UNION ALL SELECT c_custkey, 'found', 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 2 = 0)""")
def preferred_sources(spark, sf_dir):
    """Built-in sources, and of those that are found what they do not hide."""
    first = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("name")).agg(F.lit("built in").alias("maker"), F.count("*").alias("n"))
    second = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.lit("found").alias("maker"), F.lit(0).cast("long").alias("n"))
    return align.preferred_union(first, second, "name")


@query("SELECT o_orderkey AS id, o_custkey::VARCHAR AS v FROM orders UNION ALL SELECT o_orderkey + 10000000, o_orderstatus FROM orders")
def rescued_rows(spark, sf_dir):
    """Frames of one column in two types are no Parquet: all of their rows are rescued as JSON lines."""
    o = table(spark, sf_dir, "orders")
    path = scratch(spark, "rescue")
    if parquet.write_parquet([o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("v")), o.select((F.col("o_orderkey") + 10000000).alias("id"), F.col("o_orderstatus").alias("v"))], path):
        raise RuntimeError("columns of two types were written as one")
    lines = spark.read.text(f"{path}.rescue.ndjson")
    return lines.select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.get_json_object("value", "$.v").alias("v"))


@query(f"""WITH {S}, x AS (SELECT _seq, ({CODES!r})[(_seq % 4) + 1] AS word FROM s)
SELECT _seq, CASE WHEN _seq % 9 <> 0 THEN word END AS of_bytes, CASE WHEN _seq % 7 <> 0 THEN word END AS of_numbers, CASE WHEN _seq % 5 <> 0 THEN word END AS of_text FROM x""")
def chemistry_shapes(spark, sf_dir):
    """Codes told as bytes, as numbers and as text; what spells nothing is null."""
    q = F.col("_seq")
    word = F.element_at(F.array(*(F.lit(c) for c in CODES)), (q % 4 + 1).cast("int"))
    raw = F.when(q % 9 == 0, F.unhex(F.lit("4C2D49"))).otherwise(F.concat(F.unhex(F.lit("FF")), F.encode(word, "utf-8"), F.unhex(F.lit("00"))))
    numbers = F.transform(F.split(word, ""), lambda c: F.ascii(c) + 256)
    numbers = F.when(q % 7 == 0, F.concat(numbers, F.array(F.lit(None).cast("int")))).otherwise(numbers)
    told = F.when(q % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), word))
    return samples(spark, sf_dir).select("_seq", text.chemistry(raw, "bytes").alias("of_bytes"), text.chemistry(numbers, "numbers").alias("of_numbers"), text.chemistry(told, "text").alias("of_text"))
