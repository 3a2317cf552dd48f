"""Deliveries that are repeated, fail, wait and go on."""

import gzip
import json
import os
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from amperflow.sinks import outbox


@pytest.fixture
def server():
    got, bad, lock = [], {"next": 0, "with": None}, threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            lines = gzip.decompress(self.rfile.read(int(self.headers["Content-Length"]))).decode().splitlines()
            with lock:
                fails = bad["next"] > 0 or (bad["with"] is not None and any(bad["with"] in x for x in lines))
                bad["next"] -= bad["next"] > 0
                if not fails:
                    got.append((self.headers["Idempotency-Key"], [json.loads(x) for x in lines]))
            self.send_response(503 if fails else 200)
            self.end_headers()

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/x", got, bad
    s.shutdown()


def ids(got):
    return Counter(r["id"] for _, rows in got for r in rows)


def states(df):
    out = Counter()
    for r in df.collect():
        out[r.state] += r.rows
    return dict(out)


def test_a_repeated_task_posts_nothing_twice(spark, server, tmp_path):
    url, got, bad = server
    df = spark.range(0, 50, 1, 3)
    send = lambda d=df, epoch=0, **k: states(outbox.deliver(d, url, str(tmp_path), "run", epoch, rows_per_request=7, delays=(), **k))
    assert send() == {"sent": 50} and ids(got) == Counter(range(50))
    assert len({k for k, _ in got}) == len(got)
    assert send() == {"known": 50} and len(ids(got)) == 50 and max(ids(got).values()) == 1
    # Other rows at the same places, or another epoch, are no repetition.
    assert send(df.select((F.col("id") + 100).alias("id"))) == {"sent": 50}
    assert send(epoch=1) == {"sent": 50} and ids(got)[3] == 2
    # A note that was torn off is none.
    path = tmp_path / "delivered" / "run" / "1" / "0.ndjson"
    path.write_text(path.read_text()[:-20])
    assert send(epoch=1)["sent"] == 2
    outbox.Outbox(str(tmp_path), "run").forget(1)
    assert os.listdir(tmp_path / "delivered" / "run") == ["1"]


def test_failures_are_tried_again_then_wait(spark, server, tmp_path):
    url, got, bad = server
    bad["next"] = 1
    assert states(outbox.deliver(spark.range(5).coalesce(1), url, str(tmp_path), "a", delays=(0.01,))) == {"sent": 5}
    bad["with"] = ":7}"
    send = lambda: states(outbox.deliver(spark.range(20).coalesce(1), url, str(tmp_path), "b", rows_per_request=4, delays=()))
    assert send() == {"sent": 16, "spooled": 4} and send() == {"known": 20}
    assert len(outbox.waiting(str(tmp_path))) == 1
    done = outbox.drain(spark, url, str(tmp_path), rows_per_request=2).first()
    assert (done.files, done.rows, done.delivered, done.left) == (1, 4, 2, 2)
    done = outbox.drain(spark, url, str(tmp_path)).first()
    assert (done.files, done.rows, done.left) == (1, 2, 2) and len(outbox.waiting(str(tmp_path))) == 1
    bad["with"] = None
    assert outbox.drain(spark, url, str(tmp_path)).first().delivered == 2
    assert outbox.waiting(str(tmp_path)) == [] and ids(got)[7] == 1 and set(ids(got)) == set(range(20))
    assert outbox.drain(spark, url, str(tmp_path)).count() == 0
    with pytest.raises(ValueError, match="folder"):
        outbox.deliver(spark.range(1), url, "", "c")


def test_small_files_are_sent_together(spark, server, tmp_path):
    url, got, bad = server
    bad["with"] = "id"
    outbox.deliver(spark.range(0, 64, 1, 8), url, str(tmp_path), "run", rows_per_request=1, delays=()).collect()
    assert len(outbox.waiting(str(tmp_path))) == 64
    bad["with"] = None
    done = outbox.drain(spark, url, str(tmp_path), bytes_per_task=300).collect()
    assert 1 < len(done) < 16 and sum(r.delivered for r in done) == 64 and len(got) == len(done) and ids(got) == Counter(range(64))


def test_a_stream_goes_on_after_a_crash(spark, server, tmp_path):
    url, got, bad = server
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    outbox.deliver_stream(source, url, f"{tmp_path}/box", f"{tmp_path}/c", once=True, delays=()).awaitTermination()
    assert ids(got) == Counter(range(30))
    # The last batch was done, but Spark's note of it is lost.
    (commit,) = (x for x in os.listdir(tmp_path / "c" / "commits") if x == "2")
    os.remove(tmp_path / "c" / "commits" / commit)
    (tmp_path / "c" / "commits" / ".2.crc").unlink(missing_ok=True)
    outbox.deliver_stream(source, url, f"{tmp_path}/box", f"{tmp_path}/c", once=True, delays=()).awaitTermination()
    assert ids(got) == Counter(range(30))
