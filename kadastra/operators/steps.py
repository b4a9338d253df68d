"""Cutting long plans: a step that several later ones read is written once, to the shared checkpoint folder.  Joins of sides
that grow with the input: their size is guessed from the bytes of a table's file, which says nothing of rows that are
unfolded or made into rings, so such a guess must not send one to the driver."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read from there; on a local master without that setting, to a temporary
    folder.  Rows are kept once however often later steps read them, and a lost executor costs its own tasks only."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled and sorted, whatever its guessed size."""
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by keys to as many tasks as ``spark.sql.shuffle.partitions`` says: what comes next takes its time by the
    row, so few bytes are no reason for few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
