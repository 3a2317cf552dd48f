"""More registered queries, each with its SQL: rotation by time, framing, free numbers, producers of rows, deliveries that wait."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import framing, segment
from ..scratch import mounted, scratch
from ..sinks import outbox
from ..sources import producers
from .catalogue import ORACLES, QUERIES, query, samples, table, wire
from .proofs import WIRE

__all__ = ["ORACLES", "QUERIES"]

#: Hours after which a segment ends in the query.
HOURS = 6
#: All events once more as one series that holds half of all rows, in SQL.
TWICE = """e AS (SELECT 'user-' || user_id AS series_id, event_id AS _seq, ts FROM events UNION ALL SELECT 'all', event_id, ts FROM events),
s AS (SELECT *, CASE WHEN _seq % 4000 < 2500 THEN 'a' ELSE 'b' END AS run_id FROM e),
i AS (SELECT *, sum(change) OVER (PARTITION BY series_id ORDER BY _seq ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN row_number() OVER w = 1 THEN 1 WHEN run_id IS NOT DISTINCT FROM lag(run_id) OVER w THEN 0 ELSE 1 END AS change FROM s WINDOW w AS (PARTITION BY series_id ORDER BY _seq)))"""


def twice(spark, sf_dir):
    e = samples(spark, sf_dir).select("series_id", "_seq", "ts")
    both = e.union(e.select(F.lit("all"), "_seq", "ts"))
    return both.withColumn("run_id", F.when(F.col("_seq") % 4000 < 2500, "a").otherwise("b"))


@query(f"""WITH RECURSIVE {TWICE},
c AS (SELECT *, epoch_us(max(ts) OVER (PARTITION BY series_id, island ORDER BY _seq ROWS UNBOUNDED PRECEDING)) AS clock FROM i),
k AS (SELECT series_id || '/' || island AS g, clock, min(_seq) AS _seq FROM c GROUP BY ALL),
n AS (SELECT q.g, q.clock, q._seq, k.clock AS next_clock, k._seq AS next_seq FROM (SELECT *, clock + {HOURS * 3_600_000_000} AS due FROM k) q ASOF LEFT JOIN k ON q.g = k.g AND q.due <= k.clock),
cut(g, clock, next_clock, next_seq, first) AS (SELECT g, clock, next_clock, next_seq, true FROM n WHERE (g, clock) IN (SELECT (g, min(clock)) FROM k GROUP BY g)
  UNION ALL SELECT n.g, n.clock, n.next_clock, n.next_seq, false FROM cut JOIN n ON n.g = cut.g AND n.clock = cut.next_clock),
o AS (SELECT split_part(g, '/', 1) AS series_id, next_seq AS _seq FROM cut WHERE next_seq IS NOT NULL)
SELECT series_id, _seq, (island + count(o._seq) OVER (PARTITION BY series_id ORDER BY i._seq ROWS UNBOUNDED PRECEDING))::BIGINT AS segment FROM i LEFT JOIN o USING (series_id, _seq)""")
def segments_time_rotation(spark, sf_dir):
    """A new segment with every change of run, and with each first row after six hours."""
    return segment.with_aged_segments(twice(spark, sf_dir), HOURS * 3600, "ts").select("series_id", "_seq", "segment")


@query(f"""WITH RECURSIVE {WIRE},
f AS (SELECT c._seq, 'user-' || user_id AS device, printf('0F55%02X%02X%02X01%02X%04X%04X%04X%04X%02X%04X%02X', slot, type, mode, status, el, mv, ma, mah, temp, mohm, led) || printf('%02X', chk) AS good FROM c JOIN events ON event_id = c._seq),
w AS (SELECT _seq, device, CASE WHEN _seq % 13 = 0 THEN '0F0F55' ELSE '' END || CASE WHEN _seq % 10 = 0 THEN substr(good, 1, 38) || 'FF' WHEN _seq % 17 = 0 THEN substr(good, 1, 24) ELSE good END AS h FROM f),
d AS (SELECT device, string_agg(h, '' ORDER BY _seq) AS h FROM w GROUP BY device),
p AS (SELECT device, h, unnest(range(0, greatest(length(h) // 2 - 19, 0))) AS place FROM d),
hd AS (SELECT device, place, substr(h, 2 * place + 1, 40) AS frame FROM p WHERE substr(h, 2 * place + 1, 2) = '0F'),
k AS (SELECT * FROM hd WHERE list_sum(list_transform(range(0, 19), lambda j: ('0x' || substr(frame, 2 * j + 1, 2))::INTEGER)) % 256 = ('0x' || substr(frame, 39, 2))::INTEGER),
n AS (SELECT q.device, q.place, k.place AS next_place FROM (SELECT *, place + 20 AS due FROM k) q ASOF LEFT JOIN k ON q.device = k.device AND q.due <= k.place),
r(device, place, next_place) AS (SELECT device, place, next_place FROM n WHERE (device, place) IN (SELECT (device, min(place)) FROM k GROUP BY device)
  UNION ALL SELECT n.device, n.place, n.next_place FROM r JOIN n ON n.device = r.device AND n.place = r.next_place)
SELECT device, place, frame FROM r JOIN k USING (device, place)""")
def stream_frames(spark, sf_dir):
    """Frames found again in one damaged byte stream for each series, which was cut anywhere."""
    w = wire(spark, sf_dir).join(samples(spark, sf_dir).select("_seq", "series_id"), "_seq")
    data = F.concat(F.when(F.col("_seq") % 13 == 0, F.unhex(F.lit("0F0F55"))).otherwise(F.lit(b"")), "frame")
    w = w.select(F.col("series_id").alias("device"), "_seq", data.alias("data"), (F.col("_seq") % 19).cast("int").alias("cut"))
    halves = F.array(F.struct((F.col("_seq") * 2).alias("chunk"), F.expr("data").substr(F.lit(1), F.col("cut")).alias("data")), F.struct((F.col("_seq") * 2 + 1).alias("chunk"), F.expr("data").substr(F.col("cut") + 1, F.lit(100)).alias("data")))
    chunks = w.select("device", F.explode(halves).alias("x")).select("device", "x.chunk", "x.data")
    return framing.framed(chunks).select("device", "place", F.hex("frame").alias("frame"))


@query("""WITH t AS (SELECT DISTINCT c_nationkey AS cell, c_mktsegment AS day, c_custkey % 40 + 1 AS seq FROM customer WHERE c_custkey % 3 <> 0),
w AS (SELECT s_suppkey, s_nationkey AS cell, m.day, row_number() OVER (PARTITION BY s_nationkey, m.day ORDER BY s_suppkey) AS k FROM supplier, (SELECT DISTINCT c_mktsegment AS day FROM customer) m),
n AS (SELECT cell, day, seq, row_number() OVER (PARTITION BY cell, day ORDER BY seq) AS k FROM (SELECT c.cell, c.day, x.seq FROM (SELECT DISTINCT cell, day FROM w) c, (SELECT unnest(range(1, 5000)) AS seq) x WHERE (c.cell, c.day, x.seq) NOT IN (SELECT (cell, day, seq) FROM t)))
SELECT s_suppkey, w.day, n.seq::BIGINT AS seq FROM w JOIN n ON n.cell = w.cell AND n.day = w.day AND n.k = w.k""")
def free_file_numbers(spark, sf_dir):
    """The first free numbers where some are taken, with holes between them."""
    c = table(spark, sf_dir, "customer")
    taken = c.where("c_custkey % 3 <> 0").select(F.col("c_nationkey").alias("cell"), F.col("c_mktsegment").alias("day"), (F.col("c_custkey") % 40 + 1).alias("seq"))
    days = F.broadcast(c.select(F.col("c_mktsegment").alias("day")).distinct())  # market segments: a handful of names
    wanted = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("cell")).crossJoin(days)
    return segment.free_numbers(wanted, ["cell", "day"], "s_suppkey", taken).select("s_suppkey", "day", "seq")


def lines_of(name: str, content: bytes):
    """A producer for the query: a row for each line that is not empty; texts with an address are refused."""
    if b"@" in content:
        raise producers.Refused("an address")
    for k, line in enumerate(content.decode().split("\n")):
        if line:
            yield {"line": k, "chars": len(line), "first": line[:8], "unknown": 1}


LINES = """d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents), g AS (SELECT * FROM d WHERE text <> '' AND NOT contains(text, '@')),
l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM g)"""


@query(f"""WITH {LINES} SELECT doc_id, lang, line::BIGINT AS line, length(x)::BIGINT AS chars, left(x, 8) AS first, (row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1)::BIGINT AS _seq FROM l WHERE x <> ''""")
def produced_samples(spark, sf_dir):
    """Rows that a producer finds in each file, beside the file's own columns."""
    files = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("content"))
    return producers.produce(files, lines_of, "line long, chars long, first string", "doc_id")[0]


@query(f"""WITH {LINES} SELECT doc_id, CASE WHEN text = '' THEN 'empty' WHEN contains(text, '@') THEN 'an address' ELSE 'no rows' END AS _reason FROM d
WHERE text = '' OR contains(text, '@') OR doc_id NOT IN (SELECT doc_id FROM l WHERE x <> '')""")
def refused_files(spark, sf_dir):
    """Files without a row, and why."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return producers.produce(files, lines_of, "line long, chars long, first string", "doc_id")[1]


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def waiting_rows(spark, sf_dir):
    """Rows that could not be delivered: all of them wait, each once, although every task was run twice."""
    folder = mounted(scratch(spark, "outbox"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    for _ in range(2):
        outbox.deliver(rows, "http://127.0.0.1:9/", folder, "query", delays=(), timeout=2.0).collect()  # the discard port: nobody answers; one row a request
    return spark.read.schema("o_orderkey long, o_totalprice double, o_orderstatus string").json(f"file://{folder}/*.spool.ndjson")
