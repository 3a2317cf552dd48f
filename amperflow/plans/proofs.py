"""More registered queries, each for operators that the main catalogue does not reach, with their SQL.

Texts and captures are built from the driver's tables by fixed rules; the SQL states what must come
out, from the fields that went in.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import frames, redact, text, units
from ..operators import align as alignment
from ..operators import gate, ledger, project, segment, summary
from ..scratch import mounted, scratch, spread, stored
from ..sinks import feed, parquet
from ..sources import catalog, tape
from .catalogue import ORACLES, QUERIES, S, query, samples, table, values, wire

__all__ = ["ORACLES", "QUERIES"]

#: Frames of the catalogue's ``wire``, in SQL: fields, and whether the frame is sound.
WIRE = f"""{S}, b AS (SELECT _seq, k, _seq % 4 AS slot, _seq % 9 AS type, _seq % 6 AS mode, _seq % 5 AS status, (_seq % 70000) & 65535 AS el, (k * 37) & 65535 AS mv, (k * 11) & 65535 AS ma, (k * 5) & 65535 AS mah, k % 60 AS temp, _seq % 3 AS mohm, _seq % 256 AS led FROM s),
c AS (SELECT *, (15 + 85 + slot + type + mode + 1 + status + (el >> 8) + (el & 255) + (mv >> 8) + (mv & 255) + (ma >> 8) + (ma & 255) + (mah >> 8) + (mah & 255) + temp + mohm + led) & 255 AS chk FROM b),
ok AS (SELECT * FROM c WHERE NOT (_seq % 10 = 0 AND chk <> 255) AND NOT (_seq % 10 <> 0 AND _seq % 17 = 0))"""


def readings(spark, sf_dir):
    """Frames as they were captured, decoded. They are written first: a capture is not made from its own fields in one plan."""
    return stored(wire(spark, sf_dir), "wire").withColumn("r", frames.progress(F.col("frame"))).where("r is not null")


@query(f"""WITH {WIRE} SELECT _seq, mv::DOUBLE / 1000 AS voltage_volt, (CASE WHEN status = 2 THEN -1 ELSE 1 END * ma)::DOUBLE / 1000 AS current_ampere, temp::DOUBLE AS surface_temperature_celsius,
 (CASE WHEN status = 2 THEN -1 ELSE 1 END * mah)::DOUBLE / 1000 AS cumulative_capacity_ah, el::DOUBLE AS test_time_second FROM ok""")
def charger_samples(spark, sf_dir):
    """Decoded frames as samples in base units, with the device's own time."""
    return readings(spark, sf_dir).select("_seq", *project.charger_sample(F.col("r"), "device"))


@query(f"WITH {WIRE} SELECT _seq, mv > 0 AS occupied, status = 1 AS is_charging, status = 2 AS is_discharging FROM ok")
def bay_predicates(spark, sf_dir):
    """Whether a bay is occupied, charging or discharging."""
    return readings(spark, sf_dir).select("_seq", "r.occupied", "r.is_charging", "r.is_discharging")


def mode_sql() -> str:
    named = lambda names: "CASE mode " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + " ELSE 'Mode' || mode END"
    within = lambda codes: ", ".join(map(str, codes))
    return f"CASE WHEN type IN ({within(frames.LITHIUM)}) THEN {named(frames.LITHIUM_MODES)} WHEN type IN ({within(frames.ZINC)}) THEN {named(frames.ZINC_MODES)} WHEN type IN ({within(frames.NICKEL)}) THEN {named(frames.NICKEL_MODES)} ELSE 'Mode' || mode END"


@query(f"""WITH {WIRE}, ty(type, battery_type) AS (VALUES {values(frames.BATTERY_TYPES)}), st(status, status_name) AS (VALUES {values(frames.STATUSES)})
SELECT _seq, battery_type, {mode_sql()} AS mode, status_name AS status, CASE WHEN (led >> slot) & 1 = 1 THEN 'red' WHEN (led >> (slot + 4)) & 1 = 1 THEN 'green' ELSE 'none' END AS led FROM ok LEFT JOIN ty USING (type) LEFT JOIN st USING (status)""")
def frame_names(spark, sf_dir):
    """Names of battery types, modes, states and lights."""
    return readings(spark, sf_dir).select("_seq", "r.battery_type", "r.mode", "r.status", "r.led")


@query("""WITH x AS (SELECT doc_id, '0f5a' || substr(sha256(coalesce(text, '')), 1, CASE WHEN doc_id % 5 = 0 THEN 40 ELSE 60 END) AS h FROM documents)
SELECT doc_id, CASE WHEN length(h) >= 62 THEN upper(substr(h, 33, 30)) END AS serial, CASE WHEN length(h) >= 62 THEN h END AS raw_hex FROM x""")
def machine_identity(spark, sf_dir):
    """Serial numbers of identity frames; short frames have none."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    frame = F.unhex(F.concat(F.lit("0f5a"), F.when(F.col("doc_id") % 5 == 0, F.substring(digest, 1, 40)).otherwise(F.substring(digest, 1, 60))))
    df = table(spark, sf_dir, "documents").select("doc_id", frames.machine(frame).alias("m"))
    return df.select("doc_id", "m.serial", "m.raw_hex")


@query(f"WITH {S} SELECT _seq, CASE WHEN k * 2 - 100 BETWEEN -90 AND 90 AND k * 4 - 200 BETWEEN -180 AND 180 THEN (k * 2 - 100)::DOUBLE END AS lat, CASE WHEN k * 2 - 100 BETWEEN -90 AND 90 AND k * 4 - 200 BETWEEN -180 AND 180 THEN (k * 4 - 200)::DOUBLE END AS lon FROM s")
def position_gate(spark, sf_dir):
    """Positions that are on the globe, both numbers or neither."""
    p = text.position((F.col("k") * 2 - 100).cast("double"), (F.col("k") * 4 - 200).cast("double"))
    return samples(spark, sf_dir).select("_seq", p.alias("p")).select("_seq", "p.lat", "p.lon")


FLIGHTS = f"""{S}, x AS (SELECT 'log-' || user_id AS content_hash, series_id, _seq, k, CASE WHEN _seq % 41 = 0 THEN NULL ELSE ts END AS ts, CASE WHEN _seq % 29 = 0 THEN 999.0 ELSE 12.0 + (k % 10) / 16.0 END::DOUBLE AS v, CASE WHEN _seq % 3 = 0 THEN 'A' || user_id % 7 END AS air, CASE WHEN user_id % 4 <> 0 AND _seq % 2 = 0 THEN 'B' || user_id END AS pack FROM s),
id AS (SELECT content_hash, arg_min(air, _seq) FILTER (WHERE air IS NOT NULL) AS air, arg_min(pack, _seq) FILTER (WHERE pack IS NOT NULL) AS pack, min(ts) FILTER (WHERE v <= 60) AS began FROM x GROUP BY 1)"""


@query(f"""WITH {FLIGHTS}
SELECT coalesce(id.air, 'dji-drone') || ':' || coalesce(id.pack, 'pack-' || left(content_hash, 12)) AS series_id, 'flight-' || left(content_hash, 12) AS run_id, _seq, round(date_diff('microsecond', began, ts) / 1e6, 6) AS test_time_second,
 v AS voltage_volt, -1.5::DOUBLE AS current_ampere, v * -1.5 AS power_watt, 20.125::DOUBLE AS surface_temperature_celsius FROM x JOIN id USING (content_hash) WHERE ts IS NOT NULL AND v <= 60""")
def flight_samples(spark, sf_dir):
    """Samples of flight logs: signs, power, rounding, time from the first kept row, identity with fallbacks."""
    q, u = F.col("_seq"), F.col("user_id").cast("string")
    logs = samples(spark, sf_dir).select(
        F.concat(F.lit("log-"), u).alias("content_hash"), "_seq", F.when(q % 41 == 0, "1970-01-01T00:00:00Z").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("CUSTOM.dateTime"),
        F.when(q % 29 == 0, "999.0").otherwise((F.lit(12.0) + (F.col("k") % 10) / 16.0).cast("string")).alias("BATTERY.voltage"), F.lit("1.5").alias("BATTERY.current"), F.lit("20.125").alias("BATTERY.temperature"),
        F.when(q % 3 == 0, F.concat(F.lit(" A"), (F.col("user_id") % 7).cast("string"))).otherwise(" ").alias("RECOVER.aircraftSerial"), F.when((F.col("user_id") % 4 != 0) & (q % 2 == 0), F.concat(F.lit("B"), u)).alias("RECOVER.batterySerial"),
    )
    return gate.normalize_flights(logs)[0].select("series_id", "run_id", "_seq", "test_time_second", "voltage_volt", "current_ampere", "power_watt", "surface_temperature_celsius")


@query("""SELECT s_suppkey, coalesce(lower(nullif(trim(CASE WHEN s_suppkey % 3 = 0 THEN '  ' WHEN s_suppkey % 3 = 1 THEN ' ' || s_name END), '')), 'tag:' || CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END) AS key FROM supplier""")
def instance_keys(spark, sf_dir):
    """Keys of packs: their name without case, else their tag, else none."""
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit(" "), "s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", alignment.instance_key(name, F.when(k % 2 == 0, k)).alias("key"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_name END, 'none') AS attribute, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, -1.0::DOUBLE) AS amount FROM customer")
def filled_attributes(spark, sf_dir):
    """Fallbacks fill in what the primary source lacks, and override nothing."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", alignment.filled(F.when(k % 3 != 0, F.col("c_name")), F.lit("none")).alias("attribute"), alignment.filled(F.when(k % 2 == 0, F.col("c_acctbal")), F.lit(-1.0)).alias("amount"))


@query("""SELECT c_custkey, 'S' || c_custkey AS serial, CASE WHEN c_custkey % 2 = 0 THEN 'device' ELSE 'offline' END AS state, 'p' || c_nationkey AS product, CASE WHEN c_custkey % 2 = 0 THEN 'a:b' || c_custkey END AS model FROM customer
UNION ALL SELECT c_custkey, '10.0.0.' || c_custkey || ':5555', 'device', NULL, NULL FROM customer WHERE c_custkey % 3 = 0""")
def device_listing(spark, sf_dir):
    """Rows of device listings with their qualifiers."""
    k = F.col("c_custkey").cast("string")
    line = F.concat(F.lit("S"), k, F.when(F.col("c_custkey") % 2 == 0, "\tdevice").otherwise("   offline"), F.lit(" product:p"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" usb model:a:b"), k)).otherwise(""))
    second = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("10.0.0."), k, F.lit(":5555 device\n"))).otherwise("alone\n")
    listing = F.concat(F.lit("* daemon started\r\nList of devices attached\r\n"), line, F.lit("\r\n\n"), second, F.lit("adb server version (41)\n"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(text.device_table(listing)).alias("d"))
    return rows.select("c_custkey", "d.serial", "d.state", F.try_element_at("d.qualifiers", F.lit("product")).alias("product"), F.try_element_at("d.qualifiers", F.lit("model")).alias("model"))


@query("SELECT c_custkey, 'adb-' || c_custkey AS instance, '10.1.2.3:' || (30000 + c_custkey) AS address FROM customer UNION ALL SELECT c_custkey, 'x', 'host:' || c_custkey FROM customer WHERE c_custkey % 2 = 0")
def service_listing(spark, sf_dir):
    """Services that can be connected to, with a numeric port."""
    k = F.col("c_custkey")
    lines = [F.concat(F.lit("adb-"), k.cast("string"), F.lit("\t_adb-tls-connect._tcp\t10.1.2.3:"), (k + 30000).cast("string")), F.when(k % 2 == 0, F.concat(F.lit("x _adb._tcp. host:"), k.cast("string"))).otherwise("y _adb._tcp host:port"), F.lit("z _http._tcp 10.0.0.1:80")]
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(text.listeners(F.concat_ws("\n", F.lit("List of discovered mdns services"), *lines))).alias("x"))
    return rows.select("c_custkey", "x.instance", "x.address")


@query("SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(coalesce(source, '') || '  ' || coalesce(lang, '') || chr(10) || coalesce(source, '') || ' uevent', '[ \\n]+'), lambda x: x <> ''))) AS names FROM documents")
def name_sets(spark, sf_dir):
    """Distinct names of a listing."""
    listing = F.concat(F.coalesce("source", F.lit("")), F.lit("  "), F.coalesce("lang", F.lit("")), F.lit("\n"), F.coalesce("source", F.lit("")), F.lit(" uevent"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(text.name_set(listing)).alias("names"))


@query(f"""WITH {S} SELECT _seq, to_json({{'x': CASE WHEN _seq % 3 = 0 THEN NULL ELSE k + 0.5::DOUBLE END, 'b': to_base64(encode(run_id)), 'd': strftime(ts, '%Y-%m-%d'), 't': strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')}})::VARCHAR AS line FROM s""")
def json_kinds(spark, sf_dir):
    """Bytes, dates, times and numbers that are not finite, as JSON."""
    x = F.when(F.col("_seq") % 6 == 0, float("nan")).when(F.col("_seq") % 6 == 3, float("-inf")).otherwise(F.col("k") + 0.5)
    df = samples(spark, sf_dir).select("_seq", x.alias("x"), F.encode("run_id", "utf-8").alias("b"), F.to_date("ts").alias("d"), F.col("ts").alias("t"))
    return df.select("_seq", redact.json_row({"x": "double", "b": "binary", "d": "date", "t": "timestamp"}).alias("line"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN ['pw' || page_id, 'a:b'] WHEN page_id % 3 = 1 THEN ['pw' || page_id] ELSE []::VARCHAR[] END AS passwords FROM pages""")
def address_passwords(spark, sf_dir):
    """Every password in the addresses of a text."""
    k = F.col("page_id").cast("string")
    t = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("see http://u:pw"), k, F.lit("@h/x and ftp://v:a:b@h, x@y"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("db://u:pw"), k, F.lit("@h"))).otherwise(F.concat(F.lit("http://user@h "), F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", redact.passwords(t).alias("passwords"))


@query(r"""WITH x AS (SELECT page_id, 'key=ABCDEF' || page_id || ' short=ABC at ' || replace(url, '://', '://me:ABCDEF@') AS t FROM pages)
SELECT page_id, regexp_replace(replace(replace(t, 'ABCDEF', '***'), 'ABC', '***'), '([A-Za-z][A-Za-z0-9+.\-]*://)([^/@\s]+)@', '\1***@', 'g') AS line FROM x""")
def redacted_lines(spark, sf_dir):
    """Texts without given literals, the longest first, and without user info."""
    t = F.concat(F.lit("key=ABCDEF"), F.col("page_id").cast("string"), F.lit(" short=ABC at "), F.replace("url", F.lit("://"), F.lit("://me:ABCDEF@")))
    return table(spark, sf_dir, "pages").select("page_id", redact.redact_text(t, ["ABC", "ABCDEF", ""]).alias("line"))


@query(f"""WITH {S} SELECT _seq, '{{"source":{{"name":"' || run_id || '","api_key":"***","notes":["***-x",{{"password":"***","host":"h"}}]}},"creds":"***","url":"http://***@h","n":' || k || ',"auth":"***"}}' AS metadata FROM s""")
def nested_metadata(spark, sf_dir):
    """Nested metadata: secret names mask whatever stands under them, secret values go wherever they are."""
    told = '{"source":{"name":"%s","api_key":"s3cr3t","notes":["s3cr3t-x",{"password":17,"host":"h"}]},"creds":[{"user":"joe","value":"hunter2"}],"url":"http://u:pw@h","n":%d,"auth":null}'
    rows = spread(samples(spark, sf_dir).select("_seq", F.format_string(told, "run_id", "k").alias("told")), "_seq")  # what reads a file is a task for each group of its rows, a million of them
    return rows.select("_seq", redact.redact_json(F.col("told"), ["s3cr3t"]).alias("metadata"))


CODES = ["LiP", "LION", "NiMH", "PbAc"]


@query(f"WITH {S} SELECT _seq, ({CODES!r})[(_seq % 4) + 1] AS chemistry, CASE WHEN _seq % 3 = 0 THEN true END AS relative FROM s")
def packed_codes(spark, sf_dir):
    """Four-letter codes in packed integers, low byte first, and the flag for relative capacities."""
    number = lambda w: int.from_bytes(w.encode().ljust(4, b"\0"), "little")
    packed = F.element_at(F.array(*(F.lit(number(w)) for w in CODES)), (F.col("_seq") % 4 + 1).cast("int"))
    flags = F.when(F.col("_seq") % 3 == 0, F.lit(units.CAPACITY_RELATIVE + 5)).otherwise(F.lit(5))
    return samples(spark, sf_dir).select("_seq", text.chemistry(packed).alias("chemistry"), units.capacity_relative(flags).alias("relative"))


@query(f"""WITH {S}, e AS (SELECT series_id, _seq, _seq % 977 AS t, lag(_seq % 977) OVER (PARTITION BY series_id ORDER BY _seq) AS before FROM s)
SELECT series_id, _seq, (t + 65536 * sum(CASE WHEN t < before THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY _seq ROWS UNBOUNDED PRECEDING))::BIGINT AS unwrapped_s FROM e""")
def unwrapped_timer(spark, sf_dir):
    """A 16-bit run timer carried on over its turns."""
    df = samples(spark, sf_dir).select("series_id", "_seq", (F.col("_seq") % 977).alias("elapsed_s"))
    return project.unwrap_timer(df, Window.partitionBy("series_id").orderBy("_seq")).select("series_id", "_seq", F.col("unwrapped_s").cast("long").alias("unwrapped_s"))


@query(f"WITH {S} SELECT _seq, coalesce(CASE WHEN _seq % 2 = 0 THEN k::DOUBLE END, (_seq // 100)::DOUBLE) AS test_time_second FROM s")
def stamped_batches(spark, sf_dir):
    """Samples without a time of their own share their batch's."""
    df = samples(spark, sf_dir).select("_seq", F.when(F.col("_seq") % 2 == 0, F.col("k").cast("double")).alias("test_time_second"))
    return project.stamped(df, F.floor(F.col("_seq") / 100).cast("double"))


@query("SELECT s_suppkey AS pos, s_name AS instance FROM supplier WHERE lower(s_name) = (SELECT lower(min(s_name)) FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 2")
def pack_selector(spark, sf_dir):
    """Packs by name without regard to case, and by place."""
    packs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("instance"))
    least = packs.agg(F.min("instance")).first()[0]
    return alignment.select_pack(packs, f"  {least.upper()} ").union(alignment.select_pack(packs, 2))


@query(f"WITH {S} SELECT _seq, (k % 3 = 0) AS flag, CASE k % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'dat' ELSE 'unknown' END AS kind FROM s")
def typed_words(spark, sf_dir):
    """Booleans from text, and kinds of files by their suffix."""
    name = F.concat("run_id", F.when(F.col("k") % 4 == 0, ".TXT").when(F.col("k") % 4 == 1, ".Dat").otherwise(".txt.bak"))
    return samples(spark, sf_dir).select("_seq", text.as_boolean(F.when(F.col("k") % 3 == 0, "TRUE").otherwise("false")).alias("flag"), text.file_kind(name).alias("kind"))


@query(f"WITH {S} SELECT series_id, count(*)::BIGINT AS samples_collected, max(_seq // 100)::BIGINT AS last_batch, count(DISTINCT _seq // 100)::BIGINT AS polls FROM s GROUP BY series_id")
def lifetime_status(spark, sf_dir):
    """What each source has delivered since it was registered."""
    return summary.lifetime(samples(spark, sf_dir).withColumn("_batch_id", F.floor(F.col("_seq") / 100).cast("long")), "series_id")


@query(f"WITH {S} SELECT k::DOUBLE AS test_time_second, value AS voltage_volt, NULL::DOUBLE AS current_ampere, raw, _seq AS zz FROM s")
def feed_columns(spark, sf_dir):
    """What a feed file holds: the trio first, whatever else there is sorted, no routing."""
    df = samples(spark, sf_dir).select("run_id", F.col("_seq").alias("zz"), "series_id", "raw", F.col("value").alias("voltage_volt"), F.col("k").cast("double").alias("test_time_second"))
    return project.feed_columns(project.without_routing(df))


@query("""WITH f AS (SELECT doc_id, CASE WHEN length(text) > 0 THEN sha256(text) END AS content_hash FROM documents), done AS (SELECT DISTINCT content_hash FROM f WHERE doc_id % 3 = 0 AND content_hash IS NOT NULL), aside AS (SELECT DISTINCT content_hash FROM f WHERE doc_id % 7 = 1 AND content_hash IS NOT NULL)
SELECT doc_id, content_hash, CASE WHEN content_hash IN (SELECT content_hash FROM done) THEN 'ingested' WHEN content_hash IN (SELECT content_hash FROM aside) THEN 'set aside' ELSE 'new' END AS state FROM f""")
def ledger_states(spark, sf_dir):
    """A ledger written, written again and read back: what is new, imported or set aside."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), text.content_hash(F.col("text")).alias("content_hash"))
    book = ledger.Ledger(spark, scratch(spark, "ledger"))
    for _ in range(2):
        book.record(found.where("doc_id % 3 = 0"))
    aside = found.where("doc_id % 7 = 1").dropDuplicates(["content_hash"]).withColumn("reason", F.lit("no plausible row"))
    book.quarantine(book.new(aside))
    fresh = book.new(found).select("doc_id").withColumn("fresh", F.lit(True))
    done = book.ingested.select("content_hash", F.lit(True).alias("done"))
    out = found.join(done, "content_hash", "left").join(fresh, "doc_id", "left")
    return out.select("doc_id", "content_hash", F.when(F.col("done"), "ingested").when(F.col("fresh"), "new").otherwise("set aside").alias("state"))


FEED_ROWS = 4000


@query(f"""WITH {S}, f AS (SELECT CASE WHEN user_id % 8 > 0 THEN 'bay/' || user_id % 8 END AS series_id, _seq // {FEED_ROWS} AS run, _seq, value FROM s),
g AS (SELECT series_id, dense_rank() OVER (PARTITION BY series_id ORDER BY run) AS n, count(*) AS rows, sum(value) AS total FROM f GROUP BY series_id, run)
SELECT 'LOCAL__' || coalesce(replace(series_id, '/', '-'), 'default') || '__20240102_' || printf('%03d', n) || '.bdf.csv' AS file, rows::BIGINT AS rows, round(total, 6) AS total, series_id, n::BIGINT AS segment FROM g""")
def feed_files(spark, sf_dir):
    """Samples written as feed files and read back, with their descriptions: one file per series and run."""
    df = samples(spark, sf_dir).select(
        F.when(F.col("user_id") % 8 > 0, F.concat(F.lit("bay/"), (F.col("user_id") % 8).cast("string"))).alias("series_id"), F.floor(F.col("_seq") / FEED_ROWS).cast("string").alias("run_id"), "_seq",
        F.col("_seq").cast("double").alias("test_time_second"), F.col("value").alias("voltage_volt"),
    )
    path = scratch(spark, "feed")
    feed.write_feed(df, mounted(path), day="20240102")
    name = F.substring_index(F.input_file_name(), "/", -1)
    rows = spark.read.option("header", True).csv(f"{path}/*.csv").withColumn("file", name).groupBy("file").agg(F.count("*").alias("rows"), F.round(F.sum(F.col("voltage_volt").cast("double")), 6).alias("total"))
    told = spark.read.option("multiLine", True).schema("file string, rows long, finalized boolean, metadata struct<series_id string, segment long>").json(f"{path}/*.meta.json")
    told = told.where("finalized").select(F.col("file"), F.col("rows").alias("told"), "metadata.series_id", "metadata.segment")
    return rows.join(told, "file").where("rows = told").select("file", "rows", "total", "series_id", "segment")


@query("SELECT l_orderkey AS k, l_quantity AS q, NULL::DOUBLE AS p FROM lineitem UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders")
def parquet_sink(spark, sf_dir):
    """Frames of different columns through the Parquet sink and back."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("q"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    path = scratch(spark, "sink")
    if not parquet.write_parquet([a, b], path):
        raise RuntimeError("rows were rescued")
    return spark.read.parquet(path)


@query(f"WITH {S} SELECT _seq, k::DOUBLE * 0.001::DOUBLE AS voltage_volt, _seq::DOUBLE AS test_time_second FROM s WHERE _seq % 11 <> 0")
def tailed_file(spark, sf_dir):
    """Delimited files read by the tail source in ranges of bytes: mapped, scaled, bad rows out."""
    path = scratch(spark, "tail")
    q = F.col("_seq")
    df = samples(spark, sf_dir).select(q.alias("Time/s"), F.when(q % 11 == 0, "ERR").otherwise(F.col("k").cast("string")).alias("Ewe/mV"), F.lit("a,b").alias("note"))
    df.write.option("header", True).csv(path)
    out = catalog.csvtail(spark, mounted(path), {"Time/s": "test_time_second", "Ewe/mV": "voltage_volt"}, {"Ewe/mV": 0.001}, split=1 << 20)
    return out.select(F.col("test_time_second").cast("long").alias("_seq"), "voltage_volt", "test_time_second")


@query(f"""WITH {S}, w AS (SELECT _seq, series_id, _seq // 50 AS t FROM s) SELECT _seq + 1 AS line, t::DOUBLE AS t, md5(series_id) AS data, (SELECT max(t)::DOUBLE FROM w) AS duration_s FROM w""")
def tape_frames(spark, sf_dir):
    """A tape of frames read back, with its length in time."""
    path = scratch(spark, "tape")
    line = F.format_string('{"t": %d, "data": "%s"}', F.floor(F.col("_seq") / 50), F.md5("series_id"))
    lines = samples(spark, sf_dir).select("_seq", line.alias("value")).repartitionByRange("_seq").sortWithinPartitions("_seq").select("value")  # parts of the tape in order of their names
    lines.write.text(path)
    found, faults = tape.read_tape(spark, path)
    return found.crossJoin(tape.duration(found)).select("line", "t", F.lower(F.hex("data")).alias("data"), "duration_s")


@query(f"WITH {S} SELECT series_id, count(*)::BIGINT AS files, min(_seq) AS first FROM (SELECT series_id, min(_seq) AS _seq FROM s GROUP BY series_id, _seq // 1000) GROUP BY series_id")
def files_of_series(spark, sf_dir):
    """The files of each series, in the order in which they were opened."""
    m = samples(spark, sf_dir).groupBy("series_id", F.floor(F.col("_seq") / 1000).alias("segment")).agg(F.min("_seq").alias("file"))
    out = segment.files_by_series(m)
    return out.select("series_id", F.size("files").cast("long").alias("files"), F.get("files", 0).alias("first"))
