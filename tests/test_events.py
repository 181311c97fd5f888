"""Lasting events: batch against memory, stream against batch with restart and late frames."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from seqloom.streaming.events import Rule, lasting_events

START = datetime(2024, 1, 1)
RULES = [Rule("eyes_closed", "ear < 0.2", 1.0), Rule("yawn", "mar > 0.6", 2.0), Rule("head_drop", "pitch < -20", 0.0)]
SCHEMA = "user long, ts timestamp, ear double, mar double, pitch double"


def frames(rng, user, n, step=0.25):
    t, out, state = 0.0, [], [0.5, 0.1, 0.0]
    for _ in range(n):
        t += step if rng.random() < 0.97 else 3.0
        for i, (a, b) in enumerate(((0.1, 0.5), (0.9, 0.1), (-30.0, 0.0))):
            if rng.random() < 0.2:
                state[i] = rng.choice([a, b, b])
        out.append((user, START + timedelta(seconds=t), *state))
    return out


def brute(rows):
    found = set()
    for user in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == user)
        for name, holds, least in (("eyes_closed", lambda r: r[2] is not None and r[2] < 0.2, 1.0), ("yawn", lambda r: r[3] > 0.6, 2.0), ("head_drop", lambda r: r[4] < -20, 0.0)):
            run = []
            for r in [*mine, None]:
                if run and (r is None or not holds(r) or (r[1] - run[-1][1]).total_seconds() > 1.0):
                    if (run[-1][1] - run[0][1]).total_seconds() >= least:
                        found.add((user, name, run[0][1], run[-1][1], len(run)))
                    run = []
                if r is not None and holds(r):
                    run.append(r)
    return found


def rows_of(df):
    return [tuple(r) for r in df.select("user", "rule", "start", "end", "frames").collect()]


def test_batch(spark):
    rng = random.Random(1)
    rows = [r for u in range(4) for r in frames(rng, u, 120)] + [(9, START, None, 0.9, 0.0)]
    d = spark.createDataFrame([*rows, (None, START, 0.1, 0.9, -30.0), (1, None, 0.1, 0.9, -30.0)], SCHEMA).repartition(3)
    got = rows_of(lasting_events(d, "user", "ts", RULES))
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) > 20
    assert lasting_events(d.limit(0), "user", "ts", RULES).count() == 0


def test_stream_with_restart_and_late_frames(spark, tmp_path):
    rng = random.Random(2)
    rows = [r for u in range(3) for r in frames(rng, u, 80)]
    rows.sort(key=lambda r: (r[1], r[0]))
    # Frames come up to four seconds out of order, within the watermark.
    arrival = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=rng.random() * 4), r[0]))
    cut = [arrival[i : i + 40] for i in range(0, len(arrival), 40)]
    last = max(r[1] for r in rows)
    cut += [[(50, last + timedelta(minutes=5), 0.5, 0.1, 0.0)], [(51, last + timedelta(minutes=9), 0.5, 0.1, 0.0)]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(parts):
        for part in parts:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        q = lasting_events(s, "user", "ts", RULES).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(out)
        q.awaitTermination(300)
        assert q.exception() is None

    arrive(cut[:3])
    run()
    # The query is started anew; frames from before the watermark are not taken any more.
    arrive([*cut[3:-2], cut[-2], [(0, START - timedelta(hours=1), 0.1, 0.9, -30.0)], cut[-1]])
    run()
    got = rows_of(spark.read.parquet(out))
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    static = lasting_events(spark.createDataFrame(rows, SCHEMA), "user", "ts", RULES)
    assert set(rows_of(static)) == set(got) and static.where(F.col("rule") == "yawn").count() > 0
