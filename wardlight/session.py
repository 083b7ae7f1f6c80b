"""Session helpers: building a session, the shared scratch folder, and size-checked small tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables up to this many rows may be held on the driver and broadcast; larger ones take the shuffle join.
SMALL_TABLE_ROWS = 20_000
SMALL_TABLE_BYTES = 16_000_000


def build_session(app: str = "wardlight", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the operators rely on (adaptive plans, UTC, RocksDB state)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: on a cluster a machine-local folder would
    be lost with the machine, so there the setting is required.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="wardlight-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other call gets."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage of a table that several later steps read: it is computed once, survives the loss of
    executors, and the planner knows its size.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_self(df: DataFrame, max_rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """``df`` as a broadcast local table if it has at most ``max_rows`` rows and 16 MB, otherwise ``df`` unchanged.

    The check fetches ``max_rows + 1`` rows at most, so the driver never holds a table that grows with the data.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > SMALL_TABLE_BYTES:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(table, schema=df.schema))
