"""Joins of boxes against all pairs of a page."""

import random

import pytest
from pyspark.sql import functions as F

from folioweave.operators import relational, spatial
from folioweave.plans import adapters
from folioweave.plans.registry import Tables

SCHEMA = "id long, doc long, page long, x0 double, y0 double, x1 double, y1 double, name string, surface string"


def boxes(rng, n, pages=2, size=120.0):
    out = []
    for i in range(n):
        w, h = (rng.choice([0, 1, 2, 5, 10, rng.random() * size, 2.0 ** rng.randint(0, 9)]) for _ in "wh")
        x, y = (rng.choice([rng.randint(-50, 600), rng.random() * 500, 64.0, 0.0]) for _ in "xy")
        out.append((i, 1, rng.randint(1, pages), float(x), float(y), float(x + w), float(y + h), rng.choice(["a", "bb", "bb", "ccc"]), rng.choice("uv")))
    return out + [(n + i, *r[1:]) for i, r in enumerate(out[: n // 10])]


def inside(a, b, slack):
    return b[3] - slack <= a[3] and b[4] - slack <= a[4] and b[5] + slack >= a[5] and b[6] + slack >= a[6]


def area(b):
    return (b[5] - b[3]) * (b[6] - b[4])


def near(a, b):
    return a[1:3] == b[1:3]


@pytest.mark.parametrize("seed", range(3))
def test_pairs(spark, seed):
    rng = random.Random(seed)
    left, right = boxes(rng, 150), boxes(rng, 150)
    a, b = (spark.createDataFrame(x, SCHEMA) for x in (left, right))
    other = b.select("doc", "page", *spatial.BOX, F.col("id").alias("other"))
    for slack in (0, 2):
        got = sorted(map(tuple, spatial.containing(a, other, ["doc", "page"], slack).select("id", "other").collect()))
        assert got == sorted((x[0], y[0]) for x in left for y in right if near(x, y) and inside(x, y, slack))
    got = sorted(map(tuple, spatial.overlapping(a, other, ["doc", "page"]).select("id", "other").collect()))
    assert got == sorted((x[0], y[0]) for x in left for y in right if near(x, y) and x[3] < y[5] and y[3] < x[5] and x[4] < y[6] and y[4] < x[6])


@pytest.mark.parametrize("preset", relational.PRESETS)
def test_owners(spark, preset):
    rng = random.Random(7)
    left, right = boxes(rng, 120, size=20), boxes(rng, 200)
    slack, order, reject = relational.PRESETS[preset]
    want = set()
    for x in left:
        fit = [(y, {"area": area(y), "id": y[0], "length": len(y[7])}) for y in right if near(x, y) and inside(x, y, slack)]
        # The area is that of the widened box that was tested or of the box itself: the box itself.
        if fit and not (reject and sum(abs(k["area"] - min(k["area"] for _, k in fit)) < 0.01 for _, k in fit) > 1):
            want.add((x[0], min(fit, key=lambda f: [f[1][o] for o in order])[0][0]))
    got = relational.owners(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), preset)
    assert set(map(tuple, got.select("id", "owner").collect())) == want and want


def test_uncovered_and_outermost(spark):
    rng = random.Random(3)
    nodes, marks = boxes(rng, 150), boxes(rng, 40, size=10)
    n, m = spark.createDataFrame(nodes, SCHEMA), spark.createDataFrame(marks, SCHEMA)
    meet = lambda x, y: near(x, y) and x[3] < y[5] and y[3] < x[5] and x[4] < y[6] and y[4] < x[6]
    assert sorted(r["id"] for r in relational.uncovered(n, m).collect()) == sorted(x[0] for x in nodes if not any(meet(x, y) for y in marks))
    loses = lambda x: any(near(x, y) and x[8] == y[8] and inside(x, y, 1) and (area(y) > area(x) or (area(y) == area(x) and y[0] < x[0])) for y in nodes)
    assert sorted(r["id"] for r in relational.outermost(n).collect()) == sorted(x[0] for x in nodes if not loses(x))


def test_one_large_page_is_not_multiplied_out(spark):
    """4,000 small boxes and 4,000 marks on one page: far fewer comparisons than 16 million, spread over tiles."""
    rng = random.Random(5)
    place = lambda i, w, h: (i, 1, 1, x := rng.random() * 3000, y := rng.random() * 3000, x + w, y + h, "a", "u")
    a, b = spark.createDataFrame([place(i, 1, 1) for i in range(4000)], SCHEMA), spark.createDataFrame([place(i, 60, 12) for i in range(4000)], SCHEMA)
    other = b.select("doc", "page", *spatial.BOX, F.col("id").alias("other"))
    inside_ = spatial.containing(a, other, ["doc", "page"], compared=True).agg(F.count("*").alias("n"), F.count_if("_fits").alias("fit")).first()
    meet = spatial.overlapping(a, other, ["doc", "page"], compared=True).agg(F.count("*").alias("n"), F.count_if("_fits").alias("fit")).first()
    assert 0 < inside_["fit"] < inside_["n"] < 20 * inside_["fit"] < 4000 * 4000 / 10
    assert 0 < meet["fit"] < meet["n"] < 20 * meet["fit"] < 4000 * 4000 / 10


def test_bad_boxes_meet_nothing(spark):
    nan = float("nan")
    rows = [(1, 1, 1, 0.0, 0.0, 9.0, 9.0, "a", "u"), (2, 1, 1, None, 0.0, 9.0, 9.0, "a", "u"), (3, 1, 1, 5.0, 5.0, 1.0, 1.0, "a", "u"), (4, None, 1, 0.0, 0.0, 9.0, 9.0, "a", "u"), (5, 1, 1, 0.0, 0.0, nan, nan, "a", "u")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = relational.owners(df, df.where("id < 5")).collect()
    assert [(r["id"], r["owner"]) for r in got] == [(1, 1)]
    assert relational.owners(df.limit(0), df).isEmpty() and relational.owners(df, df.limit(0)).isEmpty()
    assert {r["id"] for r in relational.uncovered(df.where("id < 5"), df.where("id = 1")).collect()} == {2, 3, 4}


def test_every_mark_stands_on_a_page_with_boxes(spark):
    pages = {}
    for size in ("0.001", "0.01", "0.1"):
        t = Tables(spark, f"/root/testdata/sf{size}")
        b = adapters.boxes(t).select("doc", "page").distinct()
        pages[size] = b.count()
        assert adapters.marks(t).join(b, ["doc", "page"], "left_anti").isEmpty()
    assert 8 * pages["0.001"] < pages["0.01"] and 8 * pages["0.01"] < pages["0.1"]
