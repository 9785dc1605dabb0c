"""Feeds (STM): progress and reading state, as streams and, by the same expressions, as batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.ledger import Budget
from ..sources.sinks import changed, latest

# Stages after which nothing more comes.
TERMINAL = ("done", "error")
# Bytes of audio a second, of one recording and of one message.
AUDIO_SECOND, AUDIO_MOST, AUDIO_MESSAGE = 32_000, 960_000, 32_768
#: Most that one tick counts, and from which total a node is seen, in milliseconds.
TICK, SEEN = 1500, 4000


def progress_now(log: DataFrame, key: str = "doc_id", at: str = "at") -> DataFrame:
    """STM-01: the state of each document."""
    return latest(log, key, at)


def finished(state: DataFrame) -> bool:
    """STM-01: whether every document is done or failed."""
    return state.where(~F.col("stage").isin(*TERMINAL)).isEmpty()


def emit_changes(stream: DataFrame, keys: list[str], at: str, send: Callable[[DataFrame, int], None], checkpoint: str, state_path: str, every: str | None = None):
    """STM-01, SNK-14: start a query that sends, by micro-batch, the rows that changed against the stored state; the state is written under the batch's number, so a repeated batch compares with the same one. It ends with what is there; every: it goes on, a batch each such time (see until_finished)."""
    spark = stream.sparkSession
    schema = stream.schema

    def step(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(schema).parquet(f"{state_path}/{number - 1}") if number else spark.createDataFrame([], schema)
        now = latest(before.unionByName(batch), keys[0], at).select(schema.names)
        now.write.mode("overwrite").parquet(f"{state_path}/{number}")
        send(changed(before, spark.read.schema(schema).parquet(f"{state_path}/{number}"), keys), number)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def until_finished(run, state: Callable[[], DataFrame | None], poll: float = 1.0) -> None:
    """STM-01: waits while any document of the state is under way, then lets what has arrived go through and ends the query. state gives the state that was sent so far, or None before the first batch."""
    while not run.awaitTermination(poll):
        now = state()
        if now is not None and not now.isEmpty() and finished(now):
            run.processAllAvailable()
            if finished(state()):
                run.stop()
                return


def dwell(ticks: DataFrame, keys: list[str], at: str) -> DataFrame:
    """STM-02: total time on each key: gaps between its ticks, each at most 1500 ms, and whether 4000 ms are reached."""
    from pyspark.sql import Window

    gap = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")) - F.lag(F.unix_micros(F.col(at).cast("timestamp"))).over(Window.partitionBy(*keys).orderBy(at, "id")), F.lit(0))
    ms = ticks.withColumn("_ms", F.least(F.floor(gap / 1000), F.lit(TICK)))
    total = ms.groupBy(*keys).agg(F.sum("_ms").cast("long").alias("dwell_ms"))
    return total.withColumn("seen", F.col("dwell_ms") >= SEEN)


class Dwell(StatefulProcessor):
    """STM-02 as keyed state: (last tick, total) by key; ticks that come late add nothing."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("dwell", "last long, total long")

    def handleInputRows(self, key, rows, timer_values):
        import pandas as pd

        last, total = self.state.get() if self.state.exists() else (None, 0)
        times = sorted(int(x) for part in rows for x in part["ms"])
        for t in times:
            if last is None or t > last:
                total += 0 if last is None else min(t - last, TICK)
                last = t
        self.state.update((last, total))
        yield pd.DataFrame({"node_id": [key[0]], "dwell_ms": [total], "seen": [total >= SEEN]})

    def close(self) -> None:
        pass


def dwell_stream(ticks: DataFrame) -> DataFrame:
    """ticks: node_id long, ms long. Needs the RocksDB state store."""
    return ticks.groupBy("node_id").transformWithStateInPandas(Dwell(), "node_id long, dwell_ms long, seen boolean", "Update", "None")


class Spending(StatefulProcessor):
    """STM-05, UDF-01 as keyed state: what a budget has committed, its reservations by id, and the events that wait for the watermark.

    Events wait until the watermark has passed them and then count in the order of their time, so batches that arrive
    shuffled or twice within the lateness give the outcomes of one ordered pass. A batch of a key sets one timer, at its
    first event; when it rings, all that the watermark has passed is due, and the first of the rest gets a timer. So a
    key's state is read and written a few times a batch, not once or more for each event.
    """

    def __init__(self, limit: int, opening: int):
        self.limit, self.opening = limit, opening

    def init(self, handle) -> None:
        self.handle = handle
        self.budget = handle.getValueState("budget", "spent long, enabled boolean")
        self.open = handle.getMapState("open", "id long", "most long, settled boolean")
        self.waiting = handle.getListState("waiting", "at long, id long, kind string, amount long")

    def handleInputRows(self, key, rows, timer_values):
        new = [(int(at), int(id_), str(kind), int(amount)) for part in rows for at, id_, kind, amount in zip(part["at"].astype("int64"), part["id"], part["kind"], part["amount"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        # Of equal events one counts.
        there = sorted({tuple(k) for k in self.waiting.get()}) if self.waiting.exists() else []
        due = [k for k in there if k[0] <= now]
        rest = there[len(due) :]
        if not due:
            return
        spent, enabled = self.budget.get() if self.budget.exists() else (self.opening, True)
        b, out = Budget(self.limit, spent, enabled), []
        for id_ in {k[1] for k in due}:
            if self.open.containsKey((id_,)):
                most, settled = self.open.getValue((id_,))
                b.open[id_] = None if settled else most
        before = dict(b.open)
        for at, id_, kind, amount in due:
            outcome = b.reserve(id_, amount) if kind == "reserve" else b.settle(id_, amount)
            out.append((key[0], at, id_, kind, amount, outcome, b.spent))
        for id_, most in b.open.items():
            if id_ not in before or before[id_] != most:
                self.open.updateValue((id_,), (most or 0, most is None))
        self.budget.update((b.spent, b.enabled))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["key", "at", "id", "kind", "amount", "outcome", "committed"])

    def close(self) -> None:
        pass


def spending_stream(events: DataFrame, key: str, limit: int, opening: int = 0, late: str = "1 hour") -> DataFrame:
    """STM-05: outcomes of reservations and settlements, as ledger.budget_log() has them. events: key (long), at (milliseconds), id, kind, amount; those that come later than `late` behind the newest are left out, and of equal events one counts. Needs the RocksDB state store."""
    timed = events.select(F.col(key).cast("long").alias("key"), F.col("at").cast("long").alias("at"), F.col("id").cast("long").alias("id"), "kind", F.col("amount").cast("long").alias("amount"), F.timestamp_millis("at").alias("ts"))
    out = "key long, at long, id long, kind string, amount long, outcome string, committed long"
    return timed.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(Spending(limit, opening), out, "Append", "EventTime")


def reader_state(events: DataFrame, key: list[str]) -> DataFrame:
    """STM-03: hovers, whether known (an odd number of toggles) and seen (known ones are)."""
    out = events.groupBy(*key).agg(F.count_if(F.col("kind") == "hover").alias("hover_count"), (F.count_if(F.col("kind") == "toggle") % 2 == 1).alias("known"), (F.count_if(F.col("kind") == "seen") > 0).alias("_seen"))
    return out.withColumn("seen", F.col("_seen") | F.col("known")).drop("_seen")


def read_coverage(nodes: DataFrame, state: DataFrame, by: str) -> DataFrame:
    """AGG-14: share of nodes that are seen or known."""
    mark = F.coalesce(F.col("seen") | F.col("known"), F.lit(False))
    return nodes.join(state, "id", "left").groupBy(by).agg(F.count("*").alias("nodes"), F.count_if(mark).alias("read"), F.round(F.count_if(mark) / F.count("*"), 6).alias("share"))


def once_each(stream: DataFrame, keys: list[str], at: str | None = None, late: str = "1 hour") -> DataFrame:
    """STM-04: the first row of each key; with a time column the state of keys is dropped after the lateness."""
    return stream.dropDuplicates(keys) if at is None else stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def runnable(docs: DataFrame, ready: DataFrame, force: bool = False) -> DataFrame:
    """STM-06: documents to run, ready ones left out unless forced."""
    return docs if force else docs.join(ready.select("doc_id").distinct(), "doc_id", "left_anti")


def relayed(messages: DataFrame, keys: list[str], order: list[str], size: str) -> DataFrame:
    """STM-08: what becomes of each audio message of a recording. It is `sent`, or the first one that is of odd size, too large or over the recording's limit `closes` it, or it comes `late`: after that, or after the limit was met exactly. With the seconds sent so far."""
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.col(size)
    rows = messages.withColumn("_sum", F.sum(n).over(upto))
    rows = rows.withColumn("_bad", (n % 2 != 0) | (n > AUDIO_MESSAGE) | (F.col("_sum") > AUDIO_MOST))
    rows = rows.withColumn("_over", F.coalesce(F.max(F.col("_bad") | (F.col("_sum") == AUDIO_MOST)).over(before), F.lit(False)))
    state = F.when(F.col("_over"), "late").when(F.col("_bad"), "closes").otherwise("sent")
    out = rows.withColumn("state", state)
    return out.withColumn("seconds", F.coalesce(F.sum(F.when(F.col("state") == "sent", n)).over(upto), F.lit(0)) / AUDIO_SECOND).drop("_sum", "_bad", "_over")


def windowed(events: DataFrame, at: str, size: str, key: str, late: str | None = None) -> DataFrame:
    """Event-time counts in tumbling windows; on a stream, `late` rows are awaited."""
    rows = events if late is None else events.withWatermark(at, late)
    return rows.groupBy(F.window(at, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
