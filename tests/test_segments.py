"""The index by segments against one built anew, and versions under two writers."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from folioweave.operators import resolve, retrieval, segments
from folioweave.operators.versions import Stale, Versions

FIELDS, BOOSTS = ["title", "body"], {"title": 3.0, "body": 1.0}
NODE = "id long, title string, body string"
WORDS = "kernel image rank basis field group ring module lemma map".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, n)))


def test_scores_are_those_of_a_fresh_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "MERGE", 2)
    rng, now = random.Random(4), {}
    index = segments.Segments(spark, f"file://{tmp_path}/index", FIELDS, 4)
    queries = spark.createDataFrame([(1, "kernel of a map"), (2, "rank basis lemma"), (3, "nothing"), (4, "")], "q long, text string")
    assert index.search(queries, BOOSTS).isEmpty()
    merges = 0
    for round_ in range(5):
        new = {rng.randint(0, 60): (text(rng, 3) or None, text(rng, 12)) for _ in range(rng.choice([1, 12, 12, 40]))}
        index.add(spark.createDataFrame([(i, *t) for i, t in new.items()] + [(None, "kernel", "kernel")], NODE))
        now |= new
        if round_ == 2:
            gone = rng.sample(sorted(now), 5)
            index.remove(spark.createDataFrame([(i,) for i in [*gone, 9999]], "id long"))
            now = {i: t for i, t in now.items() if i not in gone}
        if round_ == 3:
            kept = rng.sample(sorted(now), len(now) * 2 // 3)
            index.keep_only(spark.createDataFrame([(i,) for i in [*kept, 7777]], "id long"))
            now = {i: now[i] for i in kept}
            before = len(index._state()[1]["segments"])
            index.compact()
            merges = before - len(index._state()[1]["segments"])
        fresh = spark.createDataFrame([(i, *t) for i, t in now.items()], NODE)
        want = retrieval.bm25(retrieval.index(fresh, FIELDS), retrieval.field_sizes(fresh, FIELDS), queries, BOOSTS, digits=9)
        rows = lambda df: sorted(tuple(r) for r in df.select("q", "id", "score", "rank").collect())
        assert rows(index.search(queries, BOOSTS, digits=9)) == rows(want)
    assert merges > 0 and index.sizes().count() == len(now)


def test_merges_keep_few_segments(spark, tmp_path):
    index = segments.Segments(spark, f"file://{tmp_path}/index", ["body"], 2)
    for i in range(segments.MERGE + 1):
        index.add(spark.createDataFrame([(i, "rank"), (i, "basis")], "id long, body string"))
    index.compact()
    state = index._state()[1]
    assert [s["nodes"] for s in state["segments"]] == [segments.MERGE + 1] and state["tombstones"] == []
    # Of a repeated id the least text counts.
    found = index.search(spark.createDataFrame([(1, "rank"), (2, "basis")], "q long, text string"), {"body": 1.0}).groupBy("q").count().collect()
    assert [tuple(r) for r in found] == [(2, 5)]


def test_one_of_two_writers_is_refused(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/v")
    assert v.latest() == (0, {})
    for after in range(3):
        def write(i, after=after):
            try:
                return v.commit(after, {"by": i, "more": "x" * 1000})
            except Stale:
                return None

        with ThreadPoolExecutor(6) as pool:
            got = list(pool.map(write, range(6)))
        assert [g for g in got if g] == [after + 1]
        assert v.latest() == (after + 1, {"by": got.index(after + 1), "more": "x" * 1000})
    with pytest.raises(Stale):
        v.commit(0, {})


def test_a_plan_on_a_changed_snapshot_is_refused(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/v")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    other = spark.createDataFrame([(2, "b"), (1, "c")], "id long, text string")
    plan, rival = resolve.planned(v, one, "id"), resolve.planned(v, one, "id")
    assert resolve.committed(v, plan, one.repartition(3), "id", {"entities": "t1"}) == 1
    with pytest.raises(Stale, match="version"):
        resolve.committed(v, rival, one, "id", {"entities": "t2"})
    plan = resolve.planned(v, one, "id")
    with pytest.raises(Stale, match="snapshot"):
        resolve.committed(v, plan, other, "id", {"entities": "t3"})
    assert v.latest()[1]["tables"] == {"entities": "t1"}
