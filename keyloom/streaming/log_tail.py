"""Following a growing event log: an extension, since a log is the one thing here that grows.

Losses are summarised in event-time windows with a watermark; early stopping keeps a run's best loss and waiting
count as state, so each new file costs what it holds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """A stream of JSON lines from a folder that gets new files; malformed lines are left out."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("mode", "DROPMALFORMED").json(folder)


def windowed_losses(events: DataFrame, ts: str, loss: str, size: str = "10 minutes", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, event, n, loss): counts and mean losses in tumbling or sliding windows; events later than `late` are dropped."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = events.withWatermark(ts, late).groupBy(window.alias("w"), "event").agg(F.count("*").alias("n"), F.avg(loss).alias("loss"))
    return out.select(F.col("w.start").alias("start"), "event", "n", "loss")


def sessions(events: DataFrame, ts: str, run: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(run, start, end, n): stretches of events without a gap."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), run).agg(F.count("*").alias("n"))
    return out.select(run, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def patience(evals: DataFrame, run: str, step: str, loss: str, most: int, min_delta: float = 0.0) -> DataFrame:
    """(run, step, best, waited, stopped) for each evaluation that arrives, the batch operator's fold kept as state."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, waited, stopped = state.get if state.exists else (float("inf"), 0, False)
        rows = []
        for r in pd.concat(list(parts)).sort_values(step)[[step, loss]].itertuples(index=False):
            better = r[1] < best - min_delta
            best, waited = (float(r[1]), 0) if better else (best, waited + 1)
            stopped = stopped or waited >= most
            rows.append((key[0], int(r[0]), best, waited, stopped))
        state.update((best, waited, stopped))
        yield pd.DataFrame(rows, columns=["run", "step", "best", "waited", "stopped"])

    grouped = evals.select(F.col(run).cast("string").alias("run"), step, loss).groupBy("run")
    return grouped.applyInPandasWithState(fold, "run string, step long, best double, waited int, stopped boolean", "best double, waited int, stopped boolean", "append", GroupStateTimeout.NoTimeout)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
