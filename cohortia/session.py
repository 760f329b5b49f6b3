"""Where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_root(spark: SparkSession) -> str:
    """Folder that every executor can reach: the one the cluster names.

    Only a session with a local master may go without; a temporary folder is set then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not is_local(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="cohortia-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle as the session sets them; it does not depend on the executors of the moment."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark)}/cohortia/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read back.

    For frames that are passed over several times: the plan behind them runs
    once, and a lost executor costs no recomputation of it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def listed(spark: SparkSession, columns: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """A handful of fixed rows (numbers and plain text) as a local relation."""
    values = ", ".join("(" + ", ".join(map(repr, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS listed({', '.join(columns)})")
