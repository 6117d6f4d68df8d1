"""Pairs that are read together as a stream: fading weights, promotion, eviction by timers (AGG-21)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .frames import start_landing

#: The state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SCHEMA = "a {a}, b {b}, what string, us bigint, weight double"


class _Fading(StatefulProcessor):
    """One weight a pair; it is worth half after ``half`` microseconds and goes when it falls to ``evict``."""

    def __init__(self, half: int, least: float, evict: float):
        self.half, self.least, self.evict = half, least, evict

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pair", "weight double, last bigint, told boolean, timer bigint")

    def _end(self, weight: float, last: int) -> int:
        return last + math.floor(self.half * math.log2(weight / self.evict))

    def _told(self, key, rows):
        return pd.DataFrame([(key[0], key[1], *r) for r in rows], columns=["a", "b", "what", "us", "weight"])

    def handleInputRows(self, key, rows, timerValues):
        weight, last, told, timer = self.state.get() if self.state.exists() else (0.0, None, False, None)
        if timer is not None:
            self.handle.deleteTimer(timer)
        out = []
        for us, n in pd.concat(list(rows)).sort_values("us")[["us", "n"]].itertuples(index=False):
            us, n = int(us), float(n)
            if last is not None and us >= (end := self._end(weight, last)):
                if told:
                    out.append(("EVICTED", end, self.evict))
                weight, last, told = 0.0, None, False
            if last is None or us >= last:
                weight, last = (0.0 if last is None else weight * 2.0 ** ((last - us) / self.half)) + n, us
            else:  # late, but not too late: its share has faded already
                weight += n * 2.0 ** ((us - last) / self.half)
            if not told and weight >= self.least:
                told = True
                out.append(("CLUSTERED", last, weight))
        timer = max(-(-self._end(weight, last) // 1000), timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(timer)
        self.state.update((weight, last, told, timer))
        if out:
            yield self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        weight, last, told, _ = self.state.get()
        self.state.clear()
        if told:
            yield self._told(key, [("EVICTED", self._end(weight, last), self.evict)])

    def close(self) -> None:
        pass


def fading_pairs(pairs: DataFrame, half: str = "90 days", least: float = 2.0, evict: float = 0.5, late: str = "0 seconds") -> DataFrame:
    """AGG-21: ``a, b, what, at, weight`` of a stream ``pairs(a, b, at)``, one row for each query that reads both.

    An access adds 1 to a pair's weight, which halves in every ``half`` of event time.  A pair whose weight comes to
    ``least`` is ``CLUSTERED`` (once, until it is evicted).  When the weight has faded to ``evict`` the pair's state
    goes, and a clustered pair is ``EVICTED`` at that time: by a timer, or by the access that comes after it.  So the
    state holds the pairs of the last few half-lives and not all that ever were.  Rows with a null are left out, and
    so are rows more than ``late`` behind the newest of earlier batches; ``evict`` must be above 0 and below 1, ``least`` not
    below ``evict``.
    """
    if not 0 < evict < 1 or least < evict:
        raise ValueError("0 < evict < 1 and least >= evict are needed")
    us = int(pd.Timedelta(half).value // 1000)
    rows = pairs.where("a is not null and b is not null and at is not null").withColumn("us", F.unix_micros(F.col("at").cast("timestamp"))).withColumn("n", F.lit(1))
    rows = rows.select("a", "b", F.col("at").cast("timestamp").alias("at"), "us", "n").withWatermark("at", late)
    types = {c: pairs.schema[c].dataType.simpleString() for c in ("a", "b")}
    found = rows.groupBy("a", "b").transformWithStateInPandas(_Fading(us, least, evict), _SCHEMA.format(**types), "Append", "EventTime")
    return found.select("a", "b", "what", F.timestamp_micros("us").alias("at"), "weight")


def faded(pairs: DataFrame, half: str = "90 days", least: float = 2.0, evict: float = 0.5) -> DataFrame:
    """AGG-21: what ``fading_pairs`` tells of ``pairs(a, b, at)`` that are all there, without keyed state.

    A pair's accesses are gathered in order of time and folded.  A pair weighs at most its number of accesses, so one
    with fewer than ``least`` is never clustered and is not folded.  An eviction without a later access counts if it
    lies before the newest access of all.
    """
    if not 0 < evict < 1 or least < evict:
        raise ValueError("0 < evict < 1 and least >= evict are needed")
    us = int(pd.Timedelta(half).value // 1000)
    rows = pairs.where("a is not null and b is not null and at is not null").select("a", "b", F.unix_micros(F.col("at").cast("timestamp")).alias("us"))
    newest = rows.agg(F.max("us").alias("newest"))
    each = rows.groupBy("a", "b").agg(F.sort_array(F.collect_list("us")).alias("times")).where(F.size("times") >= math.ceil(least))
    event = "array<struct<what:string,us:bigint,weight:double>>"
    tell = lambda what, at, weight: F.array(F.struct(F.lit(what).alias("what"), at.alias("us"), weight.alias("weight"))).cast(event)
    none = F.array().cast(event)
    end = lambda s: s["last"] + F.floor(F.lit(float(us)) * F.log2(s["weight"] / F.lit(evict))).cast("bigint")

    def passed(s, t):
        """Time goes on to t: the state before the access at t, evicted where it has faded."""
        gone = F.coalesce(t >= end(s), F.lit(False))
        weight = F.when(gone | s["last"].isNull(), F.lit(0.0)).otherwise(s["weight"] * F.pow(F.lit(2.0), (s["last"] - t) / F.lit(float(us))))
        out = F.when(gone & s["told"], tell("EVICTED", end(s), F.lit(evict))).otherwise(none)
        return F.struct((weight + 1.0).alias("weight"), t.alias("last"), (s["told"] & ~gone).alias("told"), F.concat(s["out"], out).alias("out"))

    def risen(s):
        rose = ~s["told"] & (s["weight"] >= least)
        out = F.concat(s["out"], F.when(rose, tell("CLUSTERED", s["last"], s["weight"])).otherwise(none))
        return F.struct(s["weight"].alias("weight"), s["last"].alias("last"), (s["told"] | rose).alias("told"), out.alias("out"))

    start = F.struct(F.lit(0.0).alias("weight"), F.lit(None).cast("bigint").alias("last"), F.lit(False).alias("told"), none.alias("out"))
    # a one-element transform names the state between both steps, so that it is computed once
    step = lambda s, t: F.element_at(F.transform(F.array(passed(s, t)), risen), 1)
    folded = each.select("a", "b", F.aggregate("times", start, step).alias("s")).crossJoin(F.broadcast(newest))
    last = F.when(F.col("s.told") & (end(F.col("s")) < F.col("newest")), tell("EVICTED", end(F.col("s")), F.lit(evict))).otherwise(none)
    return folded.select("a", "b", F.inline(F.concat("s.out", last))).select("a", "b", "what", F.timestamp_micros("us").alias("at"), "weight")


def start_fading(stream: DataFrame, path: str) -> StreamingQuery:
    """Starts what ``fading_pairs`` gave, into ``path``/table; the state store is set for this query alone."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, STORE)
    try:
        return start_landing(stream, path)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
