"""Events that last: a condition that holds from frame to frame for long enough.

An extension: the engine's configured thresholds (eyes closed, yawn, head drop) are rules that a
user states.  A batch finds events with windows over each key's frames.  A stream follows each
key with a state: frames that the watermark has not passed wait in it, so they are taken in the
order of their times however they arrive; a timer closes an event when its key falls silent.
Both give the same events but for frames that come later than the watermark allows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A name, a SQL condition on a frame, and the seconds it has to last."""

    name: str
    holds: str
    least: float


_EVENT = "rule string, start timestamp, end timestamp, frames long"


def lasting_events(frames: DataFrame, key: str, ts: str, rules: Sequence[Rule], gap: float = 1.0, late: str = "5 seconds") -> DataFrame:
    """key, rule, start, end and frames of each event: frames of a key, in the order of their
    times, for all of which the rule's condition holds, no two neighbours more than ``gap``
    seconds apart, that last at least as long as the rule says.

    Frames without key or time are passed over; a null condition does not hold.  Frames of
    equal time are taken in any order: those that hold an event up come first.
    """
    flags = F.array(*[F.coalesce(F.expr(r.holds), F.lit(False)) for r in rules])
    d = frames.select(F.col(key).alias("key"), F.col(ts).alias("ts"), flags.alias("flags")).where("key IS NOT NULL AND ts IS NOT NULL")
    found = _stream(d, rules, gap, late) if frames.isStreaming else _batch(d, rules, gap)
    return found.withColumnRenamed("key", key)


def _batch(d: DataFrame, rules: Sequence[Rule], gap: float) -> DataFrame:
    names, least = F.array(*[F.lit(r.name) for r in rules]), F.array(*[F.lit(float(r.least)) for r in rules])
    each = F.explode(F.transform("flags", lambda f, i: F.struct(F.get(names, i).alias("rule"), F.get(least, i).alias("least"), f.alias("on")))).alias("x")
    d = d.select("key", F.unix_micros("ts").alias("at"), each).select("key", "at", "x.*")
    w = Window.partitionBy("key", "rule").orderBy("at", "on")
    new = F.coalesce(~F.lag("on").over(w) | (F.col("at") - F.lag("at").over(w) > int(gap * 1e6)), F.lit(True))
    d = d.withColumn("new", new).withColumn("island", F.sum(F.col("new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("on")
    g = d.groupBy("key", "rule", "least", "island").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count(F.lit(1)).alias("frames"))
    g = g.where((F.col("end") - F.col("start")) / 1e6 >= F.col("least"))
    return g.select("key", "rule", F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "frames")


def _stream(d: DataFrame, rules: Sequence[Rule], gap: float, late: str) -> DataFrame:
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names, least, pause = [r.name for r in rules], [int(r.least * 1e6) for r in rules], int(gap * 1e6)

    def follow(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        held = json.loads(state.get[0]) if state.exists else {"waiting": [], "open": [None] * len(names)}
        if not state.hasTimedOut:
            for f in frames:
                held["waiting"] += [[int(at), [bool(x) for x in on]] for at, on in zip(f["at"], f["flags"], strict=True)]
        passed, open_, out = state.getCurrentWatermarkMs() * 1000, held["open"], []

        def close(i: int) -> None:
            start, end, n = open_[i]
            if end - start >= least[i]:
                out.append((key[0], names[i], start, end, n))
            open_[i] = None

        waiting = []
        for at, on in sorted(held["waiting"]):
            if at > passed:
                waiting.append([at, on])
                continue
            for i, yes in enumerate(on):
                if open_[i] and (not yes or at - open_[i][1] > pause):
                    close(i)
                if yes:
                    open_[i] = [open_[i][0], at, open_[i][2] + 1] if open_[i] else [at, at, 1]
        for i, x in enumerate(open_):
            if x and passed - x[1] > pause and not (waiting and waiting[0][0] - x[1] <= pause):
                close(i)
        ends = [w[0] for w in waiting[:1]] + [x[1] + pause for x in open_ if x]
        if ends:
            state.update((json.dumps({"waiting": waiting, "open": open_}),))
            state.setTimeoutTimestamp(max(min(ends) // 1000 + 1, passed // 1000 + 1))
        else:
            state.remove()
        made = pd.DataFrame(out, columns=["key", "rule", "start", "end", "frames"])
        for c in ("start", "end"):
            made[c] = pd.to_datetime(made[c], unit="us")
        yield made

    kind = d.schema["key"].dataType.simpleString()
    d = d.withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("at"), "flags")
    return d.groupBy("key").applyInPandasWithState(follow, f"key {kind}, {_EVENT}", "held string", "append", GroupStateTimeout.EventTimeTimeout)
