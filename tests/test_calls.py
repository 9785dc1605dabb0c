"""Bounded ordered calls, the cache of answers, and selection by ranges."""

import random
import threading
import time

import pytest

from folioweave.operators import aggregates, resolve


def test_calls_keep_their_order_and_bound():
    lock, under_way, most = threading.Lock(), 0, 0

    def call(i):
        nonlocal under_way, most
        with lock:
            under_way += 1
            most = max(most, under_way)
        time.sleep(0.002 * (i * 7 % 5))
        with lock:
            under_way -= 1
        return i * i

    for limit in (1, 3, 50):
        most = 0
        assert list(resolve.in_order(iter(range(30)), call, limit)) == [i * i for i in range(30)]
        assert most <= limit
    assert list(resolve.in_order([], call, 4)) == []


def test_the_first_error_ends_all_and_what_is_under_way_is_drained():
    begun, ended, fails = [], [], threading.Event()

    def call(i):
        begun.append(i)
        if i == 2:
            fails.set()
            raise ValueError("no answer")
        fails.wait(5)
        time.sleep(0.05)
        ended.append(i)
        return i

    with pytest.raises(ValueError, match="no answer"):
        list(resolve.in_order(range(100), call, 4))
    assert len(begun) <= 8 and sorted(ended) == sorted(i for i in begun if i != 2)


def test_answers_last(spark, tmp_path):
    """A second run makes no call for what is known; a failed run adds nothing."""
    cache, calls = f"file://{tmp_path}/answers", tmp_path / "calls"
    calls.mkdir()
    folder = str(calls)

    def judge(a, b):
        import pathlib
        import uuid

        if a == "bad":
            raise ValueError("no answer")
        (pathlib.Path(folder) / uuid.uuid4().hex).write_text(f"{a}|{b}")
        return ("same" if a == b else "different"), 0.5

    df = lambda rows: spark.createDataFrame(rows, "k int, left string, right string")
    one = [(1, "x", "x"), (2, "x", "y"), (3, "x", "y"), (4, None, "y"), (5, None, None)]
    rows = lambda pairs: sorted((r["k"], r["verdict"]) for r in resolve.adjudicated(df(pairs), judge, limit=2, cache=cache).collect())
    want = [(1, "same"), (2, "different"), (3, "different"), (4, "different"), (5, "same")]
    assert rows(one) == want and len(list(calls.iterdir())) == 4
    assert rows(one) == want and len(list(calls.iterdir())) == 4
    assert rows([*one, (6, "z", "z")]) == [*want, (6, "same")] and len(list(calls.iterdir())) == 5
    with pytest.raises(Exception, match="no answer"):
        rows([(1, "bad", "x"), (2, "new", "new")])
    stored = spark.read.parquet(cache)
    assert stored.count() == 5
    assert resolve.adjudicated(df([]), judge, cache=cache).isEmpty()


def test_selection_by_ranges(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("a", float(rng.randint(0, 40))) for _ in range(3000)] + [("b", rng.random()) for _ in range(2000)] + [("c", 5.0)] + [("d", None)] + [(None, float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for share in (0.0, 0.5, 0.95, 0.999):
        got = {r["k"]: r["at"] for r in aggregates.at_places(df, "k", "v", share).collect()}
        want = {}
        for k in {k for k, _ in rows}:
            v = sorted(x for key, x in rows if key == k and x is not None)
            if v:
                want[k] = v[int(len(v) * share)]
        assert got == want
    found = {r["k"]: tuple(r)[1:] for r in aggregates.latency(df, "k", "v").collect()}
    assert found["c"] == (5.0, 5.0, 5.0, 5.0) and "d" not in found and found[None][3] == 19.0
