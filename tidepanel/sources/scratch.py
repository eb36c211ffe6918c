"""Intermediate tables in the shared folder that the session names.

Writing a table cuts lineage in a way that survives the loss of an executor. The folder is spark.checkpoint.dir;
only a local session without one gets a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_folders: dict[str, str] = {}
_tables: dict[tuple[str, str], tuple[str, StructType]] = {}
_paths: dict[tuple[str, str], str] = {}


def _app(spark: SparkSession) -> str:
    return spark.sparkContext.applicationId


def folder(spark: SparkSession) -> str:
    """One folder per application, below spark.checkpoint.dir."""
    app = _app(spark)
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not base:
            base = tempfile.mkdtemp(prefix="tidepanel-")
            spark.sparkContext.setCheckpointDir(base)
        _folders[app] = f"{base.rstrip('/')}/tidepanel-{uuid.uuid4().hex}"
    return _folders[app]


def _write(df: DataFrame, name: str) -> str:
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table and read it back."""
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, name))


def shared(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Build a derived table once per application; later uses read the written copy."""
    slot = (_app(spark), key)
    if slot not in _tables:
        df = build()
        _tables[slot] = (_write(df, key.rsplit("/", 1)[-1]), df.schema)
    path, schema = _tables[slot]
    return spark.read.schema(schema).parquet(path)


def shared_path(spark: SparkSession, key: str, write: Callable[[str], None]) -> str:
    """Path of a dataset that `write` produces once per application."""
    slot = (_app(spark), key)
    if slot not in _paths:
        path = f"{folder(spark)}/{key.rsplit('/', 1)[-1]}-{uuid.uuid4().hex}"
        write(path)
        _paths[slot] = path
    return _paths[slot]
