"""Session helpers: table loading, durable cuts of lineage and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only while its values take at most so many bytes.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a directory of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Without that setting a session whose executors are threads of
    this process gets a folder of its own on this machine; any other one is refused, since its executors share no such folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        own = os.path.join(tempfile.gettempdir(), f"weftgraph-{os.getpid()}")
        os.makedirs(own, exist_ok=True)
        named = f"file://{own}"
    return named.rstrip("/")


_LIVE: dict[str, SparkSession] = {}


def _remove(path: str) -> None:
    spark = _LIVE.pop(path, None)
    try:
        sc = spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone; the cluster's own cleaning of the shared folder takes over
        pass


@atexit.register
def release() -> None:
    """Removes every table written so far. A long session calls it when it has read the results of its queries; at exit it runs by itself."""
    for path in list(_LIVE):
        _remove(path)


class Cut:
    """Cuts lineage by a compressed Parquet table in the shared folder.

    Such a table survives the loss of any executor, holds only the columns that are read again, and gives the
    planner real sizes. ``drop`` removes what a later round replaced.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def __call__(self, df: DataFrame, **seen) -> DataFrame:
        """The rows of ``df``, written and read again; aggregates in ``seen`` are taken while writing and kept as ``_weft_seen``."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        _LIVE[path] = self.spark
        watch = Observation() if seen else None
        watched = df.observe(watch, *[c.alias(k) for k, c in seen.items()]) if seen else df
        watched.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weft_path, out._weft_seen = path, watch.get if seen else {}
        return out

    @staticmethod
    def drop(df: DataFrame | None) -> None:
        path = getattr(df, "_weft_path", None)
        if path:
            _remove(path)


def _width(column, kind: T.DataType):
    """Bytes of a value, as far as its type tells them apart."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(column)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.ArrayType, T.StructType, T.MapType)):
            return F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(_width(x, kind.elementType), F.lit(0)).cast("long") + 8)
        return F.size(column) * 8
    if isinstance(kind, T.StructType):
        return sum((F.coalesce(_width(column[f.name], f.dataType), F.lit(0)) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.MapType):
        return _width(F.map_keys(column), T.ArrayType(kind.keyType)) + _width(F.map_values(column), T.ArrayType(kind.valueType))
    return F.lit(8)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its values take at most ``most`` bytes; otherwise ``df`` as it stands (its join is shuffled).

    The bytes are summed in one job over ``df``, so callers give a table that a ``Cut`` wrote, not a lineage to run twice.
    """
    wide = sum((F.coalesce(_width(F.col(f"`{f.name}`"), f.dataType), F.lit(0)) for f in df.schema.fields), F.lit(16))
    held = df.agg(F.sum(wide.cast("long"))).first()[0] or 0
    return F.broadcast(df) if held <= most else df
