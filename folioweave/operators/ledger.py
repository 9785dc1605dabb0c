"""Costs and the spending budget (NUM, STM-05, UDF-01), and constraint checks (DQ)."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .relational import small


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """NUM-01, NUM-02: cost of each call by its model's price per million tokens; a call over its model's long-context limit, of an unknown model or with impossible counts has no cost and says why.

    calls: model, total, cached, writes, output; prices: model, p_input, p_cached, p_write, p_output, most_input (null: none).
    """
    own = F.col("total") - F.col("cached") - F.col("writes")
    bad = (own < 0) | (F.least("cached", "writes", "output") < 0)
    why = F.when(F.col("p_input").isNull(), "unknown model").when(bad, "invalid usage").when(F.col("total") > F.col("most_input"), "long context")
    cost = (own * F.col("p_input") + F.col("cached") * F.col("p_cached") + F.col("writes") * F.col("p_write") + F.col("output") * F.col("p_output")) / 1_000_000
    return calls.join(small(prices), "model", "left").withColumn("input", own).withColumn("why", why).withColumn("cost", F.when(why.isNull(), cost)).drop("p_input", "p_cached", "p_write", "p_output", "most_input")


class Budget:
    """STM-05, UDF-01: reserve and settle in order. A reservation that would exceed the limit is refused; a settlement over its reservation closes the budget."""

    def __init__(self, limit: int, opening: int = 0, enabled: bool = True):
        self.limit, self.spent, self.enabled, self.open = limit, opening, enabled, {}

    def reserve(self, key, most: int) -> str:
        if not self.enabled:
            return "disabled"
        if most <= 0 or key in self.open:
            return "invalid"
        if self.spent + most > self.limit:
            return "refused"
        self.spent += most
        self.open[key] = most
        return "reserved"

    def settle(self, key, actual: int) -> str:
        most = self.open.get(key)
        if most is None or actual < 0:
            return "invalid"
        self.open[key] = None
        self.spent += actual - most
        if actual > most:
            self.enabled = False
            return "overrun"
        return "settled"


def budget_log(events: DataFrame, key: str, limit: int, opening: int = 0) -> DataFrame:
    """STM-05: each event (key, at, id, kind, amount) with its outcome and the committed sum after it. What is refused depends on all before, so one budget is one group; budgets are told apart by key and must each be small."""
    def fold(table):
        table = table.sort_by([(c, "ascending") for c in ("at", "id", "kind", "amount")])
        b, outcome, committed = Budget(limit, opening), [], []
        for id_, kind, amount in zip(*(table.column(c).to_pylist() for c in ("id", "kind", "amount")), strict=True):
            outcome.append(b.reserve(id_, amount) if kind == "reserve" else b.settle(id_, amount))
            committed.append(b.spent)
        return table.append_column("outcome", pa.array(outcome, pa.string())).append_column("committed", pa.array(committed, pa.int64()))

    rows = events.select(key, "at", "id", "kind", "amount")
    return rows.groupBy(key).applyInArrow(fold, T.StructType([*rows.schema.fields, T.StructField("outcome", T.StringType()), T.StructField("committed", T.LongType())]))


def violations(checks: dict[str, DataFrame], key: str) -> DataFrame:
    """(rule, id) of all rows that break a rule; checks: rule to the offending rows."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("id")) for rule, df in checks.items()])


def missing_reference(rows: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """DQ-01: rows whose reference stands for nothing; null is none."""
    return rows.where(F.col(column).isNotNull()).join(target.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def outside(rows: DataFrame, ok: Column) -> DataFrame:
    """DQ-02, DQ-04: rows that don't meet a condition, as a SQL CHECK sees it: null passes."""
    return rows.where(~F.coalesce(ok, F.lit(True)))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """DQ-03: keys that stand more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def retry_eligible(docs: DataFrame, reprocess: bool = False) -> DataFrame:
    """STM-07: failed documents, or ready ones on request, whose file is stored."""
    state = (F.col("status") == "error") | (F.lit(reprocess) & (F.col("status") == "ready"))
    return docs.where(state & F.col("stored"))
