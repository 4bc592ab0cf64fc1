"""Session settings, the shared scratch folder and bounded local tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Sequence
from contextlib import contextmanager
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

# Largest result that may be brought to the driver as fitted parameters.
MAX_LOCAL_ROWS = 200_000

# Spark deletes the shuffle files of a query when it ends; otherwise they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_writing: dict[int, list] = {}  # by session: writes under way and the setting before them
_writing_lock = threading.Lock()
_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(app: str = "flowspark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session.

    Functions that run in workers are found by module name there, and a worker sees
    neither the driver's folder nor its ``sys.path``.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="flowspark-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as target:
        for source in sorted(package.rglob("*.py")):
            target.write(source, source.relative_to(package.parent))
    context.addPyFile(os.fspath(archive))
    _shipped.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master, whose
    tasks all live on this machine, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
    key = context.applicationId
    if key not in _local_scratch:
        _local_scratch[key] = tempfile.mkdtemp(prefix="flowspark-")
    return _local_scratch[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the scratch folder that nothing else uses."""
    return f"{scratch_root(spark)}/flowspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_deleted(spark: SparkSession):
    """Queries that begin in here leave no shuffle files; several threads may be in here at once."""
    key = spark._jsparkSession.hashCode()
    with _writing_lock:
        held = _writing.setdefault(key, [0, spark.conf.get(CLEANUP, None)])
        held[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _writing_lock:
            held[0] -= 1
            if not held[0]:
                _writing.pop(key)
                spark.conf.unset(CLEANUP) if held[1] is None else spark.conf.set(CLEANUP, held[1])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    This cuts the lineage, fixes every non-deterministic column, survives the loss
    of executors, and keeps column pruning for the steps that follow.  What was shuffled for it goes when it is written.
    """
    path = scratch_path(df.sparkSession, name)
    with _shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once nothing will read it again."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/flowspark/{spark.sparkContext.applicationId}/" not in folder:
            raise ValueError(f"Not a scratch table: {folder}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table this application has written."""
    target = f"{scratch_root(spark)}/flowspark/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def collect_bounded(df: DataFrame, what: str, bound: int = MAX_LOCAL_ROWS) -> list[Row]:
    """Collect a parameter table, refusing anything whose size is not small."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what} has more than {bound} rows and cannot be held as parameters.")
    return rows


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """A DataFrame over local rows whose exact size the optimizer knows.

    Going through Arrow yields a local relation with true size statistics, so the
    ordinary broadcast threshold decides about joins; no hint is needed.
    """
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    frame = pd.DataFrame([tuple(r) for r in rows], columns=struct.fieldNames(), dtype=object)
    return spark.createDataFrame(frame, schema=struct)


def localise(df: DataFrame, what: str, bound: int = MAX_LOCAL_ROWS) -> DataFrame:
    """Small results become local relations, larger ones a written table."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        return materialize(df, what)
    return local_table(df.sparkSession, rows, df.schema)
