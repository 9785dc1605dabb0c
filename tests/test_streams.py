"""A progress feed that ends by itself, and the ledger as keyed state."""

import json
import threading
import time

from folioweave.operators import ledger
from folioweave.streaming import feeds


def test_the_feed_ends_when_all_is_done(spark, tmp_path):
    schema = "doc_id int, stage string, at int"
    (tmp_path / "in").mkdir()

    def put(name, rows):
        part = tmp_path / f"{name}.tmp"
        part.write_text("".join(json.dumps(dict(zip(("doc_id", "stage", "at"), r, strict=True))) + "\n" for r in rows))
        part.rename(tmp_path / "in" / f"{name}.json")

    put("a", [(1, "parse", 1), (2, "parse", 1)])
    sent, states = [], f"file://{tmp_path}/state"
    stream = spark.readStream.schema(schema).json(f"file://{tmp_path}/in")
    run = feeds.emit_changes(stream, ["doc_id"], "at", lambda df, i: sent.extend(map(tuple, df.collect())), f"file://{tmp_path}/check", states, every="1 second")

    def state():
        done = sorted(int(p.name) for p in (tmp_path / "state").glob("[0-9]*") if (p / "_SUCCESS").exists()) if (tmp_path / "state").exists() else []
        return spark.read.schema(schema).parquet(f"{states}/{done[-1]}") if done else None

    waiter = threading.Thread(target=feeds.until_finished, args=(run, state, 0.5))
    waiter.start()
    for name, rows in (("b", [(1, "done", 2)]), ("c", [(2, "edges", 3), (2, "error", 4)])):
        time.sleep(4)
        assert waiter.is_alive() and run.isActive
        put(name, rows)
    waiter.join(90)
    assert not waiter.is_alive() and not run.isActive
    assert sorted(sent) == [(1, "done", 2), (1, "parse", 1), (2, "error", 4), (2, "parse", 1)]


def test_ledger_stream_is_the_ordered_batch(spark, tmp_path):
    """Events in another order, and one of them twice."""
    rows = [(1, 5, 1, "reserve", 60), (1, 7, 1, "settle", 50), (1, 9, 2, "reserve", 60), (1, 11, 3, "reserve", 50), (1, 13, 3, "settle", 70), (1, 15, 4, "reserve", 1), (2, 6, 1, "reserve", 0), (2, 8, 9, "settle", 1), (2, 10, 1, "reserve", 100), (2, 12, 1, "reserve", 1), (2, 14, 1, "settle", 0), (2, 16, 1, "settle", 0)]
    kind = "k long, at long, id long, kind string, amount long"
    want = sorted(map(tuple, ledger.budget_log(spark.createDataFrame(rows, kind), "k", 100).collect()))
    shuffled = [rows[i] for i in (11, 3, 0, 7, 5, 9, 1, 6, 10, 2, 8, 4)]
    for i, part in enumerate((shuffled[:5], [*shuffled[5:9], shuffled[0]], shuffled[9:], [(-1, 10**12, 0, "reserve", 1)], [(-1, 10**12 + 1, 0, "reserve", 1)])):
        spark.createDataFrame(part, kind).coalesce(1).write.json(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"file://{tmp_path}/in")
    out = feeds.spending_stream(stream, "k", 100, late="30 days")
    out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").where("key > 0").collect())) == want
