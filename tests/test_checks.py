"""Each rule with a row that breaks it, and a graph and a pair of runs that break none."""

import pytest

from folioweave.operators import checks

KINDS = {
    "documents": "id string, corpus_id string, page_count int, stored boolean",
    "nodes": "id string, doc_id string, entity_id string, page int",
    "edges": "src string, dst string",
    "anchors": "id string, doc_id string, target_node_id string, target_entity_id string, card_id string",
    "cards": "id string, anchor_id string, doc_id string",
    "entities": "id string, canonical_node_id string",
}
GOOD = {
    "documents": [("d", "c", 9, True), ("e", "c", 0, True)],
    "nodes": [("n", "d", "x", 9), ("m", "e", None, 99), ("o", "d", None, None)],
    "edges": [("n", "m")],
    "anchors": [("a", "d", "n", "x", "k"), ("b", "e", None, None, None)],
    "cards": [("k", "a", "d")],
    "entities": [("x", "n"), ("y", None)],
}
BAD = {
    "documents": [("f", "other", 1, True), ("g", "c", 1, False), ("h", None, 1, None)],
    "nodes": [("p", "zz", None, 1), ("q", None, None, 1), ("r", "d", "zz", 1), ("s", "d", None, 10)],
    "edges": [("zz", "n"), ("n", "zz"), ("n", "n"), (None, "n")],
    "anchors": [("A", "zz", None, None, None), ("B", "d", "zz", None, None), ("C", "d", None, "n", None), ("D", "d", None, None, "a")],
    "cards": [("K", "zz", "d"), ("L", "a", "zz")],
    "entities": [("z", "x")],
}
WANT = [
    *[("documents", "f", "corpus"), ("documents", "g", "file"), ("documents", "h", "corpus"), ("documents", "h", "file")],
    *[("nodes", "p", "doc"), ("nodes", "q", "doc"), ("nodes", "r", "entity"), ("nodes", "s", "page")],
    *[("edges", "zz>n", "src"), ("edges", "n>zz", "dst"), ("edges", "n>n", "self-loop"), ("edges", "n", "src")],
    *[("anchors", "A", "doc"), ("anchors", "B", "target node"), ("anchors", "C", "target entity"), ("anchors", "D", "card")],
    *[("cards", "K", "anchor"), ("cards", "L", "doc"), ("entities", "z", "canonical node")],
]


def problems(spark, rows):
    t = {n: spark.createDataFrame(rows[n], k) for n, k in KINDS.items()}
    return sorted(map(tuple, checks.graph_problems(t, "c").select("table", "id", "rule").collect()))


def test_graph(spark):
    assert problems(spark, GOOD) == []
    assert problems(spark, {n: GOOD[n] + BAD[n] for n in GOOD}) == sorted(WANT)
    assert len({(t, r) for t, _, r in WANT}) == 15
    assert problems(spark, {n: [] for n in GOOD}) == []


RUN = {"run_id": "r", "kind": "live", "corpus_hash": "h", "model_config": "m", "prompt_version": "p", "scope": "full-pipeline", "pass": "cold", "c1_correct": 18, "invalid_substitutions": 0, "c3_correct": 3, "false_merges": 0}
CHANGES = {
    "synthetic": lambda r, c, s: r[1].update(kind="synthetic"),
    "the same run": lambda r, c, s: r[1].update(run_id="r0"),
    **{f"other {f}": (lambda f: lambda r, c, s: r[1].update({f: "else"}))(f) for f in checks.COMMON},
    "cases differ or repeat": lambda r, c, s: c.append((0, "c9", "ok")),
    "no evidence of a case": lambda r, c, s: c.__setitem__(0, (0, "c1", None)),
    "quality too low": lambda r, c, s: [x.update(c1_correct=16) for x in r],
    "stages repeat": lambda r, c, s: s.append((1, "embed", 0.0)),
    "results changed": lambda r, c, s: c.__setitem__(0, (0, "c1", "else")),
    "quality changed": lambda r, c, s: r[1].update(c1_correct=19),
    "other stages": lambda r, c, s: s.append((1, "voice", 0.0)),
    "stages missing": lambda r, c, s: s.__setitem__(slice(None), [x for x in s if x[1] != "embed"]),
    "no cost before": lambda r, c, s: s.__setitem__(slice(None), [(side, stage, 0.0) for side, stage, _ in s]),
    "not two runs": lambda r, c, s: r.append(dict(r[1])),
}


def test_runs(spark):
    names = list(RUN)
    runs, cases, stages = [], [], []
    for pair, (_, change) in enumerate([("none", lambda r, c, s: None), *CHANGES.items()]):
        r = [dict(RUN, run_id=f"r{side}") for side in (0, 1)]
        c = [(side, k, "ok") for side in (0, 1) for k in ("c1", "c2")]
        s = [(side, stage, 1.0) for side in (0, 1) for stage in checks.FULL]
        change(r, c, s)
        runs += [(pair, min(side, 1), *[x[n] for n in names]) for side, x in enumerate(r)]
        cases += [(pair, *x) for x in c]
        stages += [(pair, *x) for x in s]
    kinds = ", ".join(f"{n} {'int' if n in checks.QUALITY else 'string'}" for n in names)
    frames = spark.createDataFrame(runs, f"pair int, side int, {kinds}"), spark.createDataFrame(cases, "pair int, side int, case_id string, result string"), spark.createDataFrame(stages, "pair int, side int, stage string, cost double")
    got = {}
    for r in checks.incomparable(*frames).collect():
        got.setdefault(r["pair"], set()).add(r["why"])
    assert 0 not in got
    for pair, why in enumerate(CHANGES, 1):
        assert why in got[pair], why
        # A change breaks its own rule alone, but for those that follow from it.
        assert got[pair] - {why} <= {"stages missing": set(), "other scope": set(), "no evidence of a case": {"results changed"}}.get(why, set()), (why, got[pair])
