"""Sources, watermarked aggregates and stateful detectors. State is bounded by watermarks or timeouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.statistics import Gate, Wealth


def _timeout(idle_ms: int | None) -> str:
    """State of a lane goes after so long without rows; with None it stays, and a stream over finite files can end."""
    return GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout


def file_stream(spark: SparkSession, path: str, schema: str, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def windowed(events: DataFrame, time: str, by: str, value: Column, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, by, n, sum over tumbling windows; rows later than the watermark are dropped."""
    w = F.window(time, window)
    return events.withWatermark(time, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum")).select(F.col("window.start").alias("start"), by, "n", "sum")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "60 seconds", late: str = "10 minutes", least: int = 3) -> DataFrame:
    """keys, start, end, calls: calls of one signature with gaps under `gap`, at least `least` of them."""
    w = F.session_window(time, gap)
    out = events.withWatermark(time, late).groupBy(*keys, w).agg(F.count(F.lit(1)).alias("calls"))
    return out.where(F.col("calls") >= least).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "calls")


def once(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """events without repeats of a key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def budget_guard(charges: DataFrame, run: str, amount: Column, limit: float) -> DataFrame:
    """run, consumed, limit, breached: running consumption; update mode gives a row for each run that was charged."""
    used = charges.groupBy(run).agg(F.sum(amount).alias("consumed"))
    return used.select(run, "consumed", F.lit(limit).alias("limit"), (F.col("consumed") > limit).alias("breached"))


def repeated_actions(steps: DataFrame, lane: str, order: str, action: str, least: int = 3, idle_ms: int | None = 3_600_000) -> DataFrame:
    """lane, at, action, length: an alert when an action was taken `least` times in a row; a null action neither counts nor breaks."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, length = state.get if state.exists else ("", 0)
        found = []
        for pdf in batches:
            for at, what in pdf.sort_values("_at")[["_at", "_what"]].itertuples(index=False):
                if what is None or what != what:
                    continue
                last, length = (last, length + 1) if what == last else (what, 1)
                if length == least:
                    found.append((key[0], at, what, length))
        state.update((last, length))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(found, columns=["lane", "at", "action", "length"])

    rows = steps.select(F.col(lane).alias("_lane"), F.col(order).cast("long").alias("_at"), F.col(action).cast("string").alias("_what"))
    kind = rows.schema["_lane"].dataType.simpleString()
    out = f"lane {kind}, at long, action string, length long"
    return rows.groupBy("_lane").applyInPandasWithState(run, out, "last string, length long", "append", _timeout(idle_ms))


def wealth_stream(outcomes: DataFrame, lane: str, order: str, x: Column, null: float = 0.5, idle_ms: int | None = 86_400_000) -> DataFrame:
    """lane, n, wealth, decided_at after each batch: the resumable e-process; state holds five numbers a lane."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        w = Wealth(null)
        if state.exists:
            w.wealth, w.n, w.total, w.squares, decided = state.get
            w.decided = decided if decided >= 0 else None
        for pdf in batches:
            for value in pdf.sort_values("_at")["_x"]:
                w.add(float(value))
        decided = -1 if w.decided is None else w.decided
        state.update((w.wealth, w.n, w.total, w.squares, decided))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], w.n, w.wealth, decided)], columns=["lane", "n", "wealth", "decided_at"])

    rows = outcomes.select(F.col(lane).alias("_lane"), F.col(order).cast("long").alias("_at"), x.cast("double").alias("_x"))
    kind = rows.schema["_lane"].dataType.simpleString()
    return rows.groupBy("_lane").applyInPandasWithState(
        run, f"lane {kind}, n long, wealth double, decided_at long", "wealth double, n long, total double, squares double, decided long", "update", _timeout(idle_ms)
    )


class _PairedGate(StatefulProcessor):
    """One lane's gate: sides of pairs wait for each other in a map, the process and its decision are one value."""

    def __init__(self, lane: str, most: int, wait_ms: int | None, options: dict) -> None:
        self.lane, self.most, self.wait, self.options = lane, most, wait_ms, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gate", "wealth double, n long, total double, squares double, decision string")
        self.sides = handle.getMapState("sides", "pair long", "after boolean, score double, since long")

    def _gate(self) -> Gate:
        gate = Gate(self.most, **self.options)
        if self.state.exists():
            p = gate.process
            p.wealth, p.n, p.total, p.squares, gate.decision = self.state.get()
        return gate

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        gate, now = self._gate(), timers.getCurrentProcessingTimeInMs() if self.wait else 0
        for pdf in rows:
            pdf = pdf.set_axis(["_lane", "_pair", "_after", "_score"], axis=1)  # rows come by place, not by name
            for pair, after, score in pdf.sort_values(["_pair", "_after"])[["_pair", "_after", "_score"]].itertuples(index=False):
                if gate.decision != "continue":
                    continue
                pair, after, score = int(pair), bool(after), float(score)
                other = self.sides.getValue((pair,)) if self.sides.containsKey((pair,)) else None
                if other is None or other[0] == after:  # a side that comes again counts as it came first
                    if other is None:
                        self.sides.updateValue((pair,), (after, score, now))
                        if self.wait:
                            self.handle.registerTimer(now + self.wait)
                    continue
                self.sides.removeKey((pair,))
                gate.add(score - other[1] if after else other[1] - score)
        if gate.decision != "continue":
            self.sides.clear()
        p = gate.process
        self.state.update((p.wealth, p.n, p.total, p.squares, gate.decision))
        yield pd.DataFrame({self.lane: [key[0]], "n": [p.n], "wealth": [p.wealth], "decision": [gate.decision]})

    def handleExpiredTimer(self, key: tuple, timers: object, expired: object) -> Iterator[pd.DataFrame]:
        limit = expired.getExpiryTimeInMs() - self.wait
        for pair in [k for k, v in self.sides.iterator() if v[2] <= limit]:
            self.sides.removeKey(pair)
        yield pd.DataFrame({self.lane: [], "n": [], "wealth": [], "decision": []})

    def close(self) -> None:
        pass


def gate_stream(scores: DataFrame, lane: str, pair: str, after: Column, score: Column, most: int, wait_ms: int | None = 86_400_000, **options) -> DataFrame:
    """lane, n, wealth, decision after each batch: Gate over pairs as they become complete, by pair number within a batch.

    A side waits in state for the other, for wait_ms at the most (None: for ever, and no timers); once a lane has
    decided it keeps its decision and nothing else. State survives a restart from the query's checkpoint. Needs the
    RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    Gate(most, **options)
    rows = scores.select(F.col(lane).alias("_lane"), F.col(pair).cast("long").alias("_pair"), F.coalesce(after, F.lit(False)).alias("_after"), score.cast("double").alias("_score")).where("_lane is not null and _pair is not null and _score is not null")
    kind = rows.schema["_lane"].dataType.simpleString()
    processor = _PairedGate(lane, most, wait_ms, options)
    return rows.groupBy("_lane").transformWithStateInPandas(processor, f"{lane} {kind}, n long, wealth double, decision string", "Update", "ProcessingTime" if wait_ms else "None")


def pending(calls: DataFrame, receipts: DataFrame, key: str, call_time: str, receipt_time: str, within: str = "1 hour") -> DataFrame:
    """calls left-joined to their receipts within a time: a call is without one only once the watermark has passed it."""
    c = calls.withWatermark(call_time, within).alias("c")
    r = receipts.withWatermark(receipt_time, within).alias("r")
    near = F.expr(f"c.{key} = r.{key} and r.{receipt_time} between c.{call_time} and c.{call_time} + interval {within}")
    return c.join(r, near, "left_outer").select(F.col(f"c.{key}").alias(key), F.col(f"c.{call_time}").alias(call_time), F.col(f"r.{receipt_time}").alias(receipt_time))
