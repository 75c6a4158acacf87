"""Cutting the lineage of iterative frames."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The frame from a checkpoint in spark.checkpoint.dir, so that the next round plans one scan.

    A local session without that setting gets a temporary folder; a cluster without it is refused.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="keyloom-"))
    return df.checkpoint(eager=True)
