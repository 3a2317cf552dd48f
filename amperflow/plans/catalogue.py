"""Registered queries of the telemetry engine over the driver's tables, each with its SQL.

The tables stand in for telemetry: an event's user is the series, its type the run, its value the
raw reading; defects are put in by fixed rules, so that gates have something to reject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames, redact, text, units
from ..operators import align as alignment
from ..operators import contract, gate, project, segment, summary

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The adapter of events, in SQL: series, run, arrival, time, raw reading with defects, counter.
S = """s AS (SELECT 'user-' || user_id AS series_id, event_type AS run_id, event_id AS _seq, ts, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN value * 1e6 ELSE value * 1e4 END AS raw,
  value, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 97 == 0, None).when(F.col("event_id") % 89 == 0, F.col("value") * F.lit(1e6)).otherwise(F.col("value") * F.lit(1e4))
    return e.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("series_id"), F.col("event_type").alias("run_id"), F.col("event_id").alias("_seq"), "ts", raw.alias("raw"), "value", "user_id",
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
    )


VOLTS = "CASE WHEN abs({x}) >= 100000 THEN {x} / 1e6 WHEN abs({x}) >= 100 THEN {x} / 1e3 ELSE {x} END"
GATED = f"""{S}, v AS (SELECT *, {VOLTS.format(x="raw")} AS v FROM s),
g AS (SELECT *, CASE WHEN v IS NULL THEN 'no voltage' WHEN v < 0.1 OR v > 60 THEN 'pack voltage' END AS why FROM v)"""


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = units.volts(F.col("raw"))
    df = samples(spark, sf_dir).withColumn("v", v)
    none = F.lit(None).cast("double")
    return df.withColumn("why", gate.reject_reason(F.col("v"), F.lit(0.0), none, none, F.lit(0.0), F.array().cast("array<double>")))


@query(f"""WITH {GATED}, z AS (SELECT *, date_diff('microsecond', min(ts) OVER (PARTITION BY series_id), ts) / 1e6 AS t,
  CASE WHEN row_number() OVER w = 1 THEN 1 WHEN run_id IS NOT DISTINCT FROM lag(run_id) OVER w THEN 0 ELSE 1 END AS change FROM g WHERE why IS NULL WINDOW w AS (PARTITION BY series_id ORDER BY _seq)),
i AS (SELECT *, sum(change) OVER (PARTITION BY series_id ORDER BY _seq ROWS UNBOUNDED PRECEDING) AS segment FROM z)
SELECT series_id, segment::BIGINT AS segment, any_value(run_id) AS run_id, count(*)::BIGINT AS samples, min(t) AS t_start, max(t) AS t_end, arg_min(v, _seq) AS v_first, arg_max(v, _seq) AS v_last, min(v) AS v_min, max(v) AS v_max FROM i GROUP BY series_id, segment""")
def flagship_segment_summary(spark, sf_dir):
    """Per object and run segment: plausible samples, time span, first and last voltage."""
    kept = gated(spark, sf_dir).where(F.col("why").isNull())
    df = segment.with_segments(gate.zero_based(kept, "ts", "series_id"))
    return df.groupBy("series_id", "segment").agg(
        F.first("run_id").alias("run_id"), F.count("*").alias("samples"), F.min("test_time_second").alias("t_start"), F.max("test_time_second").alias("t_end"), F.min_by("v", "_seq").alias("v_first"), F.max_by("v", "_seq").alias("v_last"), F.min("v").alias("v_min"), F.max("v").alias("v_max")
    )


@query(f"""WITH {S}, x AS (SELECT _seq, CASE WHEN _seq % 11 = 0 THEN 'ERR' WHEN _seq % 13 = 0 THEN '' ELSE CAST(k AS VARCHAR) END AS a, CASE WHEN _seq % 7 = 0 THEN '' ELSE CAST(k * 2 AS VARCHAR) END AS b FROM s)
SELECT _seq, CAST(nullif(a, '') AS DOUBLE) * 0.001 AS voltage_volt, CAST(nullif(b, '') AS DOUBLE) * 1.0 AS current_ampere FROM x WHERE a <> 'ERR' AND NOT (a = '' AND b = '')""")
def map_and_scale(spark, sf_dir):
    """Renamed and scaled text columns; bad rows rejected."""
    k = F.col("k").cast("string")
    raw = samples(spark, sf_dir).select("_seq", F.when(F.col("_seq") % 11 == 0, "ERR").when(F.col("_seq") % 13 == 0, "").otherwise(k).alias("Ewe/mV"), F.when(F.col("_seq") % 7 == 0, "").otherwise((F.col("k") * 2).cast("string")).alias("I/mA"))
    return project.map_and_scale(raw, {"Ewe/mV": "voltage_volt", "I/mA": "current_ampere"}, {"Ewe/mV": 0.001}, keep=("_seq",))[0]


@query(f"""WITH {S}, x AS (SELECT _seq, CASE _seq % 8 WHEN 0 THEN '3d' WHEN 1 THEN 'nan' WHEN 2 THEN ' 12 ' WHEN 3 THEN '-1.5e2' WHEN 4 THEN '.5' WHEN 5 THEN 'inf' WHEN 6 THEN '1_000' ELSE CAST(k AS VARCHAR) END AS t FROM s)
SELECT _seq, CASE WHEN regexp_matches(trim(t), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(trim(t) AS DOUBLE) END AS number FROM x""")
def numeric_parse_strict(spark, sf_dir):
    """Finite numbers from text, nothing else."""
    names = ["3d", "nan", " 12 ", "-1.5e2", ".5", "inf", "1_000"]
    t = F.col("k").cast("string")
    for i, n in enumerate(names):
        t = F.when(F.col("_seq") % 8 == i, n).otherwise(t)
    return samples(spark, sf_dir).select("_seq", units.strict_double(t).alias("number"))


@query(f"""WITH {S} SELECT _seq, {VOLTS.format(x="raw")} AS volt, CASE WHEN abs(raw) >= 10000 THEN raw / 1e6 WHEN abs(raw) >= 100 THEN raw / 1e3 ELSE raw END AS ampere,
 CASE WHEN abs(k) > 100 THEN k::DOUBLE / 10 ELSE k::DOUBLE END AS celsius, greatest(0.0, least(100.0, k::DOUBLE)) AS percent,
 CASE WHEN user_id % 3 IN (0) THEN greatest(0.0, least(100.0, k::DOUBLE)) ELSE greatest(0.0, least(100.0, k::DOUBLE * 100 / ((user_id % 3) * 60))) END AS soc FROM s""")
def unit_normalize(spark, sf_dir):
    """Voltage, current, temperature and level heuristics."""
    scale = (F.col("user_id") % 3) * 60
    return samples(spark, sf_dir).select("_seq", units.volts(F.col("raw")).alias("volt"), units.amperes(F.col("raw")).alias("ampere"), units.celsius(F.col("k")).alias("celsius"), units.clamped_percent(F.col("k")).alias("percent"), units.level_percent(F.col("k"), scale).alias("soc"))


@query(f"""WITH {S}, x AS (SELECT _seq, raw, CASE run_id WHEN 'click' THEN ' Charging' WHEN 'view' THEN 'DISCHARGING' ELSE run_id END AS status FROM s)
SELECT _seq, CASE lower(trim(status)) WHEN 'charging' THEN abs(raw) WHEN 'discharging' THEN -abs(raw) ELSE raw END AS current_ampere FROM x""")
def sign_from_status(spark, sf_dir):
    """Current signed by status."""
    status = F.when(F.col("run_id") == "click", " Charging").when(F.col("run_id") == "view", "DISCHARGING").otherwise(F.col("run_id"))
    return samples(spark, sf_dir).select("_seq", units.signed_by_status(F.col("raw"), status).alias("current_ampere"))


@query(f"""WITH {S} SELECT _seq, coalesce(nullif(trim(CASE WHEN k % 2 = 0 THEN '  ' END), ''), nullif(trim(CASE WHEN k % 3 = 0 THEN ' a ' ELSE '' END), ''), series_id) AS name FROM s""")
def coalesce_fallback(spark, sf_dir):
    """The first text that is not blank."""
    return samples(spark, sf_dir).select("_seq", text.first_text(F.when(F.col("k") % 2 == 0, "  "), F.when(F.col("k") % 3 == 0, " a ").otherwise(""), F.col("series_id")).alias("name"))


@query(f"""WITH {S}, x AS (SELECT _seq, CASE WHEN _seq % 5 = 0 THEN 2147483648.0 ELSE k * 100.0 END AS charge, CASE WHEN _seq % 7 = 0 THEN 0.0 ELSE k * 40.0 END AS mv, k * 10.0 AS rem, CASE WHEN _seq % 3 = 0 THEN 0.0 ELSE 900.0 END AS ful FROM s),
y AS (SELECT *, CASE WHEN abs(charge) <> 2147483648.0 THEN charge END AS c FROM x)
SELECT _seq, mv / 1000 AS voltage_volt, coalesce(c, 0) / 1000 AS power_watt, CASE WHEN mv / 1000 > 0 THEN (coalesce(c, 0) / 1000) / (mv / 1000) ELSE 0 END AS current_ampere,
 CASE WHEN ful > 0 THEN greatest(0.0, least(100.0, 100.0 * rem / ful)) END AS state_of_charge_percent FROM y""")
def derived_power_current_soc(spark, sf_dir):
    """Watts, amperes and state of charge of a pack from milli-units with unknown numbers."""
    k, s = F.col("k"), F.col("_seq")
    status = {"voltage_mv": F.when(s % 7 == 0, 0.0).otherwise(k * 40.0), "charge_mw": F.when(s % 5 == 0, float(units.UNKNOWN_NUMBER)).otherwise(k * 100.0), "discharge_mw": F.lit(0.0), "remaining_mwh": k * 10.0}
    out = project.power_pack(status, F.when(s % 3 == 0, 0.0).otherwise(900.0), F.lit(1))
    return samples(spark, sf_dir).select("_seq", *out[:4])


@query(f"WITH {GATED} SELECT _seq, v FROM g WHERE why IS NULL")
def plausibility_kept(spark, sf_dir):
    """What the gate lets through."""
    return gated(spark, sf_dir).where(F.col("why").isNull()).select("_seq", "v")


@query(f"WITH {GATED} SELECT coalesce(why, 'kept') AS reason, count(*)::BIGINT AS n FROM g GROUP BY 1")
def plausibility_reject_counts(spark, sf_dir):
    """Rejections are counted by reason."""
    return gated(spark, sf_dir).groupBy(F.coalesce("why", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {S}, x AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'id-' || k END AS ident FROM s) SELECT series_id, arg_min(ident, _seq) FILTER (WHERE ident IS NOT NULL) AS ident FROM x GROUP BY series_id")
def first_nonempty_identity(spark, sf_dir):
    """The first identity that is not empty, over all rows in order."""
    ident = F.when(F.col("k") % 4 == 0, F.concat(F.lit("id-"), F.col("k").cast("string"))).otherwise("")
    df = samples(spark, sf_dir).withColumn("ident", text.clean(ident))
    return df.groupBy("series_id").agg(F.min_by("ident", F.when(F.col("ident").isNotNull(), F.col("_seq"))).alias("ident"))


@query(f"WITH {S} SELECT series_id, arg_max(raw, _seq) FILTER (WHERE raw IS NOT NULL) AS remaining FROM s GROUP BY series_id")
def last_value_context(spark, sf_dir):
    """The last known value of each series."""
    return samples(spark, sf_dir).groupBy("series_id").agg(F.max_by("raw", F.when(F.col("raw").isNotNull(), F.col("_seq"))).alias("remaining"))


@query(f"WITH {S} SELECT series_id, arg_min(k, (ts, _seq)) AS soc_start, arg_max(k, (ts, _seq)) AS soc_end, max(value) AS highest FROM s GROUP BY series_id")
def soc_window(spark, sf_dir):
    """First and last level in order of time, and the highest value."""
    at = F.struct("ts", "_seq")
    return samples(spark, sf_dir).groupBy("series_id").agg(F.min_by("k", at).alias("soc_start"), F.max_by("k", at).alias("soc_end"), F.max("value").alias("highest"))


@query(f"WITH {S} SELECT series_id, CASE WHEN count(*) FILTER (WHERE run_id = 'click') > 0 THEN (count(*) FILTER (WHERE run_id = 'click') * 1000000 // count(*))::BIGINT END AS active_ppm FROM s GROUP BY series_id")
def active_fraction(spark, sf_dir):
    """The share of active rows, in millionths; none where there are none."""
    on = F.count_if(F.col("run_id") == "click")
    return samples(spark, sf_dir).groupBy("series_id").agg(F.when(on > 0, F.floor(on * 1000000 / F.count("*")).cast("long")).alias("active_ppm"))


@query(f"WITH {S} SELECT _seq, date_diff('microsecond', min(ts) OVER (PARTITION BY series_id, run_id), ts) / 1e6 AS test_time_second FROM s")
def zero_base_time(spark, sf_dir):
    """Each series and run starts at 0."""
    return gate.zero_based(samples(spark, sf_dir), "ts", "series_id", "run_id").select("_seq", "test_time_second")


ISLANDS = f"""{S}, c AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 1 WHEN run_id IS NOT DISTINCT FROM lag(run_id) OVER w THEN 0 ELSE 1 END AS change FROM s WINDOW w AS (PARTITION BY series_id ORDER BY _seq)),
i AS (SELECT *, sum(change) OVER (PARTITION BY series_id ORDER BY _seq ROWS UNBOUNDED PRECEDING) AS island FROM c),
r AS (SELECT *, CASE WHEN (row_number() OVER (PARTITION BY series_id, island ORDER BY _seq) - 1) % 3 = 0 THEN 1 ELSE 0 END AS turn FROM i),
q AS (SELECT *, sum(turn) OVER (PARTITION BY series_id ORDER BY _seq ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM r)"""


@query(f"WITH {ISLANDS} SELECT _seq, island::BIGINT AS segment FROM i")
def segments_islands(spark, sf_dir):
    """A new segment with every change of run."""
    return segment.with_segments(samples(spark, sf_dir)).select("_seq", "segment")


@query(f"WITH {ISLANDS} SELECT _seq, segment FROM q")
def segments_row_rotation(spark, sf_dir):
    """And with every third row of a run."""
    return segment.with_segments(samples(spark, sf_dir), rows=3).select("_seq", "segment")


@query(f"WITH {ISLANDS} SELECT series_id, segment, any_value(run_id) AS run_id, count(*)::BIGINT AS rows, min(_seq) AS first_seq, max(_seq) AS last_seq FROM q GROUP BY series_id, segment")
def segment_manifest(spark, sf_dir):
    """One row per segment."""
    return segment.manifest(segment.with_segments(samples(spark, sf_dir), rows=3))


def numbered(df: DataFrame) -> DataFrame:
    """Segments of every third row, with number and file name per cell and day."""
    df = segment.with_segments(df, rows=3)
    m = df.groupBy("series_id", "segment").agg(F.min("_seq").alias("first_seq"), F.min(F.to_date("ts")).alias("day")).withColumn("cell", F.col("series_id"))
    return segment.numbered_files(m, "LOCAL", F.col("day")).select("series_id", "segment", "seq", "file")


@query(f"""WITH {ISLANDS}, m AS (SELECT series_id, segment, min(_seq) AS first_seq, min(ts)::DATE AS day FROM q GROUP BY series_id, segment)
SELECT series_id, segment, (row_number() OVER (PARTITION BY lower(series_id), day ORDER BY first_seq))::BIGINT AS seq,
 'LOCAL__' || series_id || '__' || strftime(day, '%Y%m%d') || '_' || printf('%03d', row_number() OVER (PARTITION BY lower(series_id), day ORDER BY first_seq)) || '.bdf.csv' AS file FROM m""")
def file_sequence_names(spark, sf_dir):
    """Numbered file names per cell and day, of all series."""
    return numbered(samples(spark, sf_dir))


SANITIZED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[<>:"/\\|?*\x00-\x1f]', '-', 'g'), '\s+', '-', 'g'), '_{{2,}}', '-', 'g'), '-{{2,}}', '-', 'g')"""
CELL = r"""coalesce(nullif(regexp_replace(left(""" + SANITIZED + r""", 60), '^[-._ ]+|[-._ ]+$', '', 'g'), ''), 'unknown')"""


@query(f"SELECT page_id, {CELL.format(x='url')} AS cell FROM pages")
def cell_name_sanitize(spark, sf_dir):
    """File-safe names."""
    return table(spark, sf_dir, "pages").select("page_id", text.cell_name(F.col("url")).alias("cell"))


@query(f"""WITH n AS (SELECT source || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '?' END || coalesce(lang, 'none') AS series_id, min(doc_id) AS first_seq FROM documents GROUP BY 1),
b AS (SELECT *, {CELL.format(x='series_id')} AS base FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY first_seq) AS k FROM b)
SELECT series_id, CASE WHEN k = 1 THEN base ELSE base || '-' || left(sha256(series_id), 8) END AS cell FROM r""")
def cell_name_collisions(spark, sf_dir):
    """Names that collide get a hash of their id, but for the first to arrive."""
    d = table(spark, sf_dir, "documents")
    name = F.concat("source", F.when(F.col("doc_id") % 2 == 0, "/").otherwise("?"), F.coalesce("lang", F.lit("none")))
    return segment.cell_names(d.groupBy(name.alias("series_id")).agg(F.min("doc_id").alias("first_seq"))).select("series_id", "cell")


@query("""WITH l AS (SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 4 <> 0 THEN lower(s_name) END AS key FROM supplier),
r AS (SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 5 <> 0 THEN lower(s_name) END AS key, s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey + 100000, lower(s_name), s_acctbal + 1 FROM supplier WHERE s_suppkey % 7 = 0),
k AS (SELECT key, arg_max(v, pos) AS v FROM r WHERE key IS NOT NULL GROUP BY key)
SELECT l.pos, l.key, k.v AS matched FROM l LEFT JOIN k USING (key)""")
def align_left_join_fallback(spark, sf_dir):
    """Rows lined up by key, last duplicate first; by place only where counts are equal."""
    s = table(spark, sf_dir, "supplier")
    key = lambda m: F.when(F.col("s_suppkey") % m != 0, F.lower("s_name"))
    left = s.select(F.col("s_suppkey").alias("pos"), key(4).alias("key"))
    right = s.select(F.col("s_suppkey").alias("pos"), key(5).alias("key"), F.col("s_acctbal").alias("matched"))
    right = right.union(s.where("s_suppkey % 7 = 0").select(F.col("s_suppkey") + 100000, F.lower("s_name"), F.col("s_acctbal") + 1))
    return alignment.align(left, right, ["matched"])


@query("""WITH l AS (SELECT n_nationkey::BIGINT AS pos FROM nation), r AS (SELECT n_nationkey::BIGINT AS pos, n_name AS name FROM nation) SELECT l.pos, r.name FROM l LEFT JOIN r USING (pos)""")
def align_by_place(spark, sf_dir):
    """Without keys and with equal counts, rows line up by place."""
    n = table(spark, sf_dir, "nation")
    pos, key = F.col("n_nationkey").cast("long").alias("pos"), F.lit(None).cast("string").alias("key")
    return alignment.align(n.select(pos, key), n.select(pos, key, F.col("n_name").alias("name")), ["name"]).select("pos", "name")


@query("""WITH f AS (SELECT doc_id, CASE WHEN length(text) > 0 THEN sha256(text) END AS content_hash FROM documents), l AS (SELECT DISTINCT content_hash FROM f WHERE doc_id % 3 = 0 AND content_hash IS NOT NULL)
SELECT doc_id, content_hash FROM f WHERE content_hash IS NULL OR content_hash NOT IN (SELECT content_hash FROM l)""")
def ledger_anti_join(spark, sf_dir):
    """Files whose content no ledger entry has."""
    f = table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return f.join(f.where("doc_id % 3 = 0 and content_hash is not null").select("content_hash").distinct(), "content_hash", "left_anti").select("doc_id", "content_hash")


@query("SELECT doc_id, CASE WHEN length(text) > 0 THEN sha256(text) END AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    """SHA-256 of content, none for nothing."""
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents WHERE length(text) > 0 GROUP BY 1")
def content_dedupe(spark, sf_dir):
    """One entry per content."""
    f = table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash")).where("content_hash is not null")
    return f.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def items_and_orders(items: DataFrame, orders: DataFrame) -> DataFrame:
    a = items.select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("q"))
    return contract.union_ragged(a, orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p")))


@query("SELECT l_orderkey AS k, l_quantity AS q, NULL::DOUBLE AS p FROM lineitem UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders")
def union_ragged(spark, sf_dir):
    """Rows of different columns under the union of their columns, of all lines."""
    return items_and_orders(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


@query(f"WITH {S}, n AS (SELECT _seq, series_id, row_number() OVER (PARTITION BY series_id ORDER BY _seq DESC) AS r FROM s) SELECT _seq, series_id FROM n WHERE r <= 5")
def ring_buffer_latest_n(spark, sf_dir):
    """The newest five rows of each series."""
    return summary.newest(samples(spark, sf_dir).select("_seq", "series_id"), 5, "_seq", "series_id")


@query(f"WITH {S} SELECT series_id, count(*)::BIGINT AS received_total, greatest(count(*) - 5, 0)::BIGINT AS dropped_total FROM s GROUP BY series_id")
def ring_buffer_stats(spark, sf_dir):
    """What such a buffer received and dropped."""
    return summary.buffer_stats(samples(spark, sf_dir), 5, "series_id")


@query(f"WITH {S} SELECT _seq AS address, CASE WHEN k % 10 <> 0 THEN k END AS rssi FROM s ORDER BY rssi DESC NULLS LAST, address LIMIT 50")
def rssi_sort_topk(spark, sf_dir):
    """The strongest signals, unknown ones last."""
    return summary.strongest(samples(spark, sf_dir).select(F.col("_seq").alias("address"), F.when(F.col("k") % 10 != 0, F.col("k")).alias("rssi")), 50)


@query("""SELECT event_id AS step, round(2.0::DOUBLE + 1.0::DOUBLE * (1.0::DOUBLE - least(event_id::DOUBLE / 3600, 1.0::DOUBLE) * least(event_id::DOUBLE / 3600, 1.0::DOUBLE)), 6) AS voltage_volt, -0.002::DOUBLE AS current_ampere, round(25.0::DOUBLE + 0.5::DOUBLE * sin(event_id::DOUBLE / 30), 6) AS surface_temperature_celsius FROM events""")
def simulator_curve(spark, sf_dir):
    """A simulated discharge, one step per event."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), *units.simulated_sample(F.col("event_id")))


def wire(spark, sf_dir) -> DataFrame:
    s = samples(spark, sf_dir)
    k, q = F.col("k"), F.col("_seq")
    fields = F.struct(
        (q % 4).alias("slot"), (q % 9).alias("battery_type_code"), (q % 6).alias("mode_code"), F.lit(1).alias("program_count"), (q % 5).alias("status_code"), (q % 70000).alias("elapsed_s"), (k * 37).alias("voltage_mv"), (k * 11).alias("current_ma"),
        (k * 5).alias("capacity_mah"), (k % 60).alias("temperature"), (q % 3).alias("resistance_mohm"), (q % 256).alias("led_bits"),
    )
    good = frames.encode_progress(fields, frames.BLE_LENGTH)
    return s.select("_seq", F.when(q % 10 == 0, F.concat(good.substr(F.lit(1), F.lit(19)), F.unhex(F.lit("FF")))).when(q % 17 == 0, good.substr(F.lit(1), F.lit(12))).otherwise(good).alias("frame"))


@query(f"""WITH {S}, b AS (SELECT _seq, _seq % 4 AS slot, _seq % 9 AS type, _seq % 6 AS mode, _seq % 5 AS status, (_seq % 70000) & 65535 AS el, (k * 37) & 65535 AS mv, (k * 11) & 65535 AS ma, (k * 5) & 65535 AS mah, k % 60 AS temp, _seq % 3 AS mohm, _seq % 256 AS led FROM s),
c AS (SELECT *, (15 + 85 + slot + type + mode + 1 + status + (el >> 8) + (el & 255) + (mv >> 8) + (mv & 255) + (ma >> 8) + (ma & 255) + (mah >> 8) + (mah & 255) + temp + mohm + led) & 255 AS chk FROM b)
SELECT _seq, CASE WHEN _seq % 10 = 0 AND chk <> 255 THEN 'checksum' WHEN _seq % 10 <> 0 AND _seq % 17 = 0 THEN 'length' ELSE 'ok' END AS verdict,
 CASE WHEN NOT (_seq % 10 = 0 AND chk <> 255) AND NOT (_seq % 10 <> 0 AND _seq % 17 = 0) THEN mv::INTEGER END AS voltage_mv,
 CASE WHEN NOT (_seq % 10 = 0 AND chk <> 255) AND NOT (_seq % 10 <> 0 AND _seq % 17 = 0) THEN CASE WHEN mohm IN (0, 1) THEN NULL ELSE mohm END::INTEGER END AS resistance_mohm FROM c""")
def frame_decode(spark, sf_dir):
    """Frames checked and decoded; sentinels are null."""
    df = wire(spark, sf_dir).withColumn("d", frames.decoded(F.col("frame")))
    return df.select("_seq", F.coalesce("d.reject_reason", F.lit("ok")).alias("verdict"), F.col("d.reading.voltage_mv").alias("voltage_mv"), F.col("d.reading.resistance_mohm").alias("resistance_mohm"))


def values(names: dict[int, str]) -> str:
    return ", ".join(f"({k}, '{v}')" for k, v in names.items())


@query(f"""WITH {S}, x AS (SELECT _seq, (k % 8)::INTEGER AS code FROM s), st(code, name) AS (VALUES {values(text.BATTERY_STATUS)}), he(code, name) AS (VALUES {values(text.BATTERY_HEALTH)})
SELECT _seq, coalesce(st.name, code::VARCHAR) AS status, coalesce(he.name, code::VARCHAR) AS health FROM x LEFT JOIN st USING (code) LEFT JOIN he USING (code)""")
def status_lookup(spark, sf_dir):
    """Names of codes; a code without one is its own text."""
    code = (F.col("k") % 8).cast("int")
    return samples(spark, sf_dir).select("_seq", text.battery_status(code).alias("status"), text.battery_health(code).alias("health"))


@query("SELECT l_linenumber AS k, least(1.0 * pow(2.0, l_linenumber - 1), 30.0) AS wait_s, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def backoff_schedule(spark, sf_dir):
    """Waiting times after failures."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k"), units.backoff(F.col("l_linenumber")).alias("wait_s")).agg(F.count("*").alias("n"))


@query(f"""WITH {S}, x AS (SELECT series_id, CASE WHEN _seq % 13 = 0 THEN NULL WHEN _seq % 7 = 0 THEN -1.0 ELSE value END AS t, CASE WHEN _seq % 5 = 0 THEN 'nan'::DOUBLE ELSE value END AS v FROM s)
SELECT * FROM (SELECT 'time is negative' AS rule, count(*) FILTER (WHERE t < 0)::BIGINT AS rows FROM x UNION ALL SELECT 'routed row without time', count(*) FILTER (WHERE t IS NULL)::BIGINT FROM x UNION ALL SELECT 'voltage_volt is not finite', count(*) FILTER (WHERE isnan(v))::BIGINT FROM x) WHERE rows > 0""")
def contract_violations(spark, sf_dir):
    """Rules broken by samples, counted."""
    q = F.col("_seq")
    df = samples(spark, sf_dir).select("series_id", F.when(q % 13 == 0, None).when(q % 7 == 0, -1.0).otherwise(F.col("value")).alias("test_time_second"), F.when(q % 5 == 0, float("nan")).otherwise(F.col("value")).alias("voltage_volt"))
    return contract.violations(df)


@query(r"""WITH x AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(url, '://', '://user:pa-' || page_id || '@') ELSE url END AS u FROM pages)
SELECT page_id, regexp_replace(u, '([A-Za-z][A-Za-z0-9+.\-]*://)([^/@\s]+)@', '\1***@', 'g') AS masked FROM x""")
def redact_userinfo(spark, sf_dir):
    """Addresses without the credentials in them."""
    u = F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("://"), F.concat(F.lit("://user:pa-"), F.col("page_id").cast("string"), F.lit("@")))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", redact.mask_userinfo(u).alias("masked"))


WORDLIST = ["access_token", "path", "dbPassword", "spinner", "pin", "APIKey2", "asphalt", "salt", "author", "session_id", "otp-code", "interval", "privateKey", "format"]


@query(f"""WITH x AS (SELECT event_id, ({WORDLIST!r})[(event_id % {len(WORDLIST)}) + 1] AS name FROM events)
SELECT event_id, name, name IN ('access_token', 'dbPassword', 'pin', 'APIKey2', 'salt', 'session_id', 'otp-code', 'privateKey') AS secret FROM x""")
def secret_key_mask(spark, sf_dir):
    """Which names tell of a secret."""
    name = F.element_at(F.array(*(F.lit(w) for w in WORDLIST)), (F.col("event_id") % len(WORDLIST) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", name.alias("name")).withColumn("secret", redact.is_secret_name(F.col("name")))


@query(f"WITH {S}, x AS (SELECT series_id, _seq AS line, value AS t, lag(value) OVER (PARTITION BY series_id ORDER BY _seq) AS before FROM s) SELECT series_id, line, t, before FROM x WHERE t < before")
def tape_monotonic_check(spark, sf_dir):
    """Frames that lie before the one above."""
    return summary.monotonic_breaks(samples(spark, sf_dir).select("series_id", F.col("_seq").alias("line"), F.col("value").alias("t")), "t", "line", "series_id")


@query(f"WITH {S} SELECT count(*)::BIGINT AS samples, count(DISTINCT _seq // 100)::BIGINT AS batches, ['raw', 'run_id', 'series_id', 'value'] AS columns FROM s")
def run_stats(spark, sf_dir):
    """Samples, batches and columns of a run."""
    df = samples(spark, sf_dir).select("series_id", "run_id", "raw", "value", F.lit(None).cast("double").alias("never"), F.floor(F.col("_seq") / 100).cast("long").alias("_batch_id"))
    return summary.run_stats(df)


@query(f"""WITH {S} SELECT _seq, CASE WHEN _seq % 3 = 0 THEN 'ac' WHEN _seq % 5 = 0 THEN 'usb' ELSE 'none' END AS plugged, (k)::DOUBLE AS level FROM s""")
def dumpsys_parse(spark, sf_dir):
    """Lines of key and value as a map; priorities among power sources."""
    q = F.col("_seq")
    dump = F.concat(F.lit("Current Battery Service state:\n  AC powered: "), F.when(q % 3 == 0, "true").otherwise("false"), F.lit("\n  USB powered: "), F.when(q % 5 == 0, "true").otherwise("false"), F.lit("\n  level: "), F.col("k").cast("string"), F.lit("\n"))
    df = samples(spark, sf_dir).select("_seq", text.key_values(dump).alias("m"))
    return df.select("_seq", F.lower(text.plugged(F.col("m"))).alias("plugged"), units.strict_double(F.try_element_at("m", F.lit("level"))).alias("level"))


@query("""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS bare FROM pages""")
def bare_addresses(spark, sf_dir):
    """Addresses without user info, query and fragment."""
    return table(spark, sf_dir, "pages").select("page_id", redact.bare_address(F.col("url")).alias("bare"))


@query(f"""WITH {S}, x AS (SELECT _seq, [CASE WHEN k % 2 = 0 THEN 0.0 ELSE 3.75 END::DOUBLE, 3.5::DOUBLE, CASE WHEN k % 3 = 0 THEN NULL ELSE 3.25 END::DOUBLE] AS c FROM s)
SELECT _seq, CASE WHEN c[1] = 0 THEN [] WHEN c[3] IS NULL THEN c[1:2] ELSE c END AS cells FROM x""")
def cells_take_while(spark, sf_dir):
    """Cell voltages up to the first that is missing or 0."""
    c = F.array(F.when(F.col("k") % 2 == 0, 0.0).otherwise(3.75), F.lit(3.5), F.when(F.col("k") % 3 == 0, None).otherwise(3.25))
    return samples(spark, sf_dir).select("_seq", text.leading_cells(c).alias("cells"))


@query(f"""WITH {S}, x AS (SELECT series_id, _seq, k, CASE WHEN _seq % 41 = 0 THEN NULL ELSE ts END AS ts, CASE WHEN _seq % 29 = 0 THEN 999.0 ELSE 12.0 + (k % 10) / 16.0 END AS v FROM s),
g AS (SELECT *, CASE WHEN ts IS NULL THEN 'bad_ts' WHEN v > 60 THEN 'implausible' END AS why FROM x)
SELECT series_id, count(*)::BIGINT AS rows_total, count(*) FILTER (WHERE why IS NULL)::BIGINT AS records, count(*) FILTER (WHERE why = 'bad_ts')::BIGINT AS bad_ts, count(*) FILTER (WHERE why = 'implausible')::BIGINT AS implausible,
 arg_min(k::DOUBLE, (ts, _seq)) FILTER (WHERE why IS NULL) AS soc_start_pct FROM g GROUP BY series_id""")
def flight_summary(spark, sf_dir):
    """Flight logs through the gate: one summary per file."""
    q = F.col("_seq")
    logs = samples(spark, sf_dir).select(
        F.col("series_id").alias("content_hash"), "_seq", F.when(q % 41 == 0, "1970-01-01T00:00:00Z").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("CUSTOM.dateTime"),
        F.when(q % 29 == 0, "999.0").otherwise((F.lit(12.0) + (F.col("k") % 10) / 16.0).cast("string")).alias("BATTERY.voltage"), F.lit("1.5").alias("BATTERY.current"), F.col("k").cast("string").alias("BATTERY.chargeLevel"),
    )
    s = gate.normalize_flights(logs)[1]
    return s.select(F.col("content_hash").alias("series_id"), "rows_total", "records", "bad_ts", "implausible", "soc_start_pct")


@query(f"""WITH {S} SELECT _seq, to_json({{'a': CASE WHEN _seq % 4 = 0 THEN NULL ELSE k END, 'b': CASE WHEN _seq % 3 = 0 THEN NULL ELSE series_id END}})::VARCHAR AS line FROM s""")
def json_lines(spark, sf_dir):
    """Rows as JSON with nulls kept, numbers that are not finite as null."""
    df = samples(spark, sf_dir).select("_seq", F.when(F.col("_seq") % 4 == 0, None).otherwise(F.col("k")).alias("a"), F.when(F.col("_seq") % 3 == 0, None).otherwise(F.col("series_id")).alias("b"))
    return df.select("_seq", redact.json_row({"a": "int", "b": "string"}).alias("line"))


@query("""SELECT c_custkey AS pos, CASE WHEN c_custkey % 3 = 0 THEN 'connected' ELSE 'listening' END AS origin FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0""")
def discover_union(spark, sf_dir):
    """Connected devices, and listeners that are not connected already."""
    c = table(spark, sf_dir, "customer")
    connected = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("pos"), F.lit("connected").alias("origin"))
    return alignment.preferred_union(connected, c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("pos"), F.lit("listening").alias("origin")), "pos")


@query("""WITH i AS (SELECT c_custkey AS user_id, n_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT event_id, place FROM events LEFT JOIN i USING (user_id)""")
def enrich_lookup(spark, sf_dir):
    """A lookup join, broadcast only while the lookup table is small."""
    i = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("place"))
    return alignment.enriched(table(spark, sf_dir, "events").select("event_id", "user_id"), i, "user_id").select("event_id", "place")
