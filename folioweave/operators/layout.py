"""Positions of a map's nodes by simulated forces (GRF-11), one map a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Steps, and distance, charge and radius of large and of small maps.
TICKS = 180
LARGE, SMALL = (55.0, -85.0, 14.0), (115.0, -260.0, 42.0)
#: How an undisturbed simulation cools down, and what a step leaves of a speed.
COOLING, DRAG = 1 - 0.001 ** (1 / 300), 0.6
#: Nodes that keep apart from all at once, and nodes that one product of NumPy holds against all.
BLOCK, PART = 512, 64


def beside(points: np.ndarray, low: int, high: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of each point low to before high with every other one whose x lies within reach: all that can be nearer than that."""
    order = np.argsort(points[:, 0], kind="stable")
    x = points[order, 0]
    first, last = np.searchsorted(x, points[low:high, 0] - reach, "left"), np.searchsorted(x, points[low:high, 0] + reach, "right")
    size = last - first
    i = np.repeat(np.arange(low, high), size)
    j = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)]
    return i[i != j], j[i != j]


def settled(n: int, links: np.ndarray, width: float = 800.0, height: float = 600.0, ticks: int = TICKS) -> np.ndarray:
    """Positions (n, 2): links are springs, all nodes repel each other and keep apart, weak forces draw them to the middle. Nodes start on a spiral, so the same map gets the same positions."""
    distance, charge, radius = LARGE if n > 100 else SMALL
    i = np.arange(n)
    turn, middle = i * np.pi * (3 - 5**0.5), np.array([width / 2, height / 2])
    at = 10 * np.sqrt(0.5 + i)[:, None] * np.stack([np.cos(turn), np.sin(turn)], 1)
    speed, heat = np.zeros((n, 2)), 1.0
    a, b = links[:, 0], links[:, 1]
    degree = np.bincount(links.ravel(), minlength=n).astype(float)
    share = degree[a] / np.maximum(degree[a] + degree[b], 1)
    links_ = list(zip(a.tolist(), b.tolist(), share.tolist(), strict=True))
    for _ in range(ticks):
        heat -= heat * COOLING
        # Links in turn, on plain numbers: each sees the speeds that those before it left.
        x, y, u, v = (c.tolist() for c in (at[:, 0], at[:, 1], speed[:, 0], speed[:, 1]))
        for source, target, weight in links_:
            dx, dy = x[target] + u[target] - x[source] - u[source], y[target] + v[target] - y[source] - v[source]
            far = max(abs(complex(dx, dy)), 1e-6)
            push = (far - distance) / far * heat * 0.25
            u[target] -= dx * push * weight
            v[target] -= dy * push * weight
            u[source] += dx * push * (1 - weight)
            v[source] += dy * push * (1 - weight)
        speed = np.stack([u, v], 1)
        for k in range(0, n, PART):  # PART nodes against all, so memory grows with the nodes
            dx, dy = (at[:, c, None] - at[None, k : k + PART, c] for c in (0, 1))
            pull = dx * dx
            pull += dy * dy
            np.maximum(pull, 1.0, out=pull)
            np.divide(charge * heat, pull, out=pull)
            # A node's own gap is zero, so it does not push itself.
            dx *= pull
            dy *= pull
            speed[k : k + PART] += np.stack([dx.sum(0), dy.sum(0)], 1)
        at += middle - at.mean(0)
        speed += (middle - at) * (np.array([0.015, 0.1]) * heat)
        for k in range(0, n, BLOCK):
            here = at + speed
            i, j = beside(here, k, min(k + BLOCK, n), 2 * radius)
            far = np.sqrt(((here[i] - here[j]) ** 2).sum(1))
            i, j, far = i[far < 2 * radius], j[far < 2 * radius], far[far < 2 * radius]
            # In order of the nodes, so sums do not depend on where they are.
            order = np.lexsort((j, i))
            i, j, far = i[order], j[order], far[order]
            gap, near = here[i] - here[j], (2 * radius - far) / np.maximum(far, 1e-6) / 2
            for c in (0, 1):
                speed[:, c] += np.bincount(i, gap[:, c] * near, n)
        speed *= DRAG
        at += speed
    return at


def layout(nodes: DataFrame, edges: DataFrame, key: str = "corpus") -> DataFrame:
    """GRF-11: (key, id, x, y) of each map's nodes. nodes: key, id; edges: key, src, dst. A step needs all positions of the step before, so a map is one group, and must be small enough to be looked at; maps run side by side."""
    kind = dict(nodes.dtypes)
    rows = nodes.select(key, F.col("id").alias("a"), F.lit(None).cast(kind["id"]).alias("b")).distinct().unionByName(edges.select(key, F.col("src").alias("a"), F.col("dst").alias("b")).distinct())

    def place(table: pa.Table) -> pa.Table:
        a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
        ids = sorted(x for x, y in zip(a, b, strict=True) if y is None)
        number = {x: i for i, x in enumerate(ids)}
        links = sorted((number[x], number[y]) for x, y in zip(a, b, strict=True) if y is not None and x in number and y in number and x != y)
        at = settled(len(ids), np.array(links, np.int64).reshape(-1, 2))
        group = pa.array([table.column(key)[0].as_py()] * len(ids), table.schema.field(key).type)
        return pa.table([group, pa.array(ids, table.schema.field("a").type), pa.array(at[:, 0]), pa.array(at[:, 1])], [key, "id", "x", "y"])

    # A map is few bytes and much work, so by their bytes all maps would be put into one task.
    tasks = min(4 * nodes.select(key).distinct().count(), 2000) or 1
    return rows.repartition(tasks, key).groupBy(key).applyInArrow(place, f"`{key}` {kind[key]}, id {kind['id']}, x double, y double")
