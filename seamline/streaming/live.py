"""Match state ball by ball as a stream, and windowed totals with a watermark.

The batch semantics are the model: a stream of the same deliveries ends in the same state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "match_id string, innings int, balls long, score long, wickets long, momentum long, run_rate double"
KEPT = "seen array<array<int>>"


def live_state(balls: DataFrame, window: int = 12) -> DataFrame:
    """balls (streaming) -> the state of each innings after each micro-batch that has a ball of it.

    The kept state is a short row a ball of the innings, of which there are a few hundred at most, by its place: a
    delivery that arrives again changes nothing, and one that arrives late takes its place. So the stream ends in the
    state of the batch."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = {(x[0], x[1]): tuple(x[2:]) for x in (state.get[0] if state.exists else [])}
        for b in batches:
            for o, q, legal, runs, out in zip(b["over_no"], b["delivery_seq"], b["is_legal"], b["runs_total"], b["wicket"]):
                seen.setdefault((int(o), int(q)), (int(legal), int(runs), int(out)))
        state.update(([[*k, *v] for k, v in seen.items()],))
        v = [seen[k] for k in sorted(seen)]
        legal, score = sum(x[0] for x in v), sum(x[1] for x in v)
        rate = math.floor(score * 6.0 / legal * 100 + 0.5) / 100 if legal else 0.0
        yield pd.DataFrame([(key[0], int(key[1]), len(v), score, sum(x[2] for x in v), sum(x[1] for x in v[-window:]), rate)], columns=[c.split()[0] for c in OUT.split(", ")])

    cols = ["match_id", "innings", "over_no", "delivery_seq", "is_legal", "runs_total", "wicket"]
    return balls.select(*cols).groupBy("match_id", "innings").applyInPandasWithState(step, OUT, KEPT, "update", GroupStateTimeout.NoTimeout)


def arrivals(balls: DataFrame, late: str = "21 days", every: str = "1 day") -> DataFrame:
    """Balls and runs by day of arrival; what comes later than the watermark is dropped. Times are read as UTC."""
    d = balls.withColumn("at", F.col("loaded_at").cast("timestamp")).withWatermark("at", late)
    return d.groupBy(F.window("at", every).alias("w")).agg(F.count("*").alias("n_balls"), F.sum("runs_total").alias("runs")).select(F.col("w.start").alias("day"), "n_balls", "runs")


def once_per_delivery(balls: DataFrame, late: str = "21 days") -> DataFrame:
    """The first arrival of each delivery within the watermark: state is dropped behind it, so it stays bounded."""
    d = balls.withColumn("at", F.col("loaded_at").cast("timestamp")).withWatermark("at", late)
    return d.dropDuplicatesWithinWatermark(["match_id", "innings", "over_no", "delivery_seq"])
