"""Shared-folder tables and small column helpers for the training-data operators."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWNED: dict[tuple[str, str], list[str]] = {}
_SCOPE = contextvars.ContextVar("scope", default="")


@contextlib.contextmanager
def scope(name: str):
    """Tables staged inside belong to ``name``, so that ``release`` can drop them alone."""
    token = _SCOPE.set(name)
    try:
        yield
    finally:
        _SCOPE.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    ``spark.checkpoint.dir`` of the session, or what was set on the context.  Only where neither
    is set and all executors are threads of this machine (tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="panelwright-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/panelwright/{name}-{uuid.uuid4().hex}"
    _OWNED.setdefault((spark.sparkContext.applicationId, _SCOPE.get()), []).append(path)
    return path


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    A lost executor then costs a task and never the whole history, and later steps read columns
    instead of computing them again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession, name: str = "") -> None:
    """Delete the tables staged so far in a scope.  Only for callers whose results are already written."""
    for path in _OWNED.pop((spark.sparkContext.applicationId, name), []):
        delete(spark, path)


#: Keys with more than one in ``HOT_SHARE`` of a table's rows are dealt to several tasks, but none with fewer rows than ``HOT_ROWS``.
HOT_SHARE, HOT_ROWS = 1000, 64


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], rows: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has one row a key and in column ``rows`` how many rows of ``big`` hold it.

    A key with more rows than a bound is dealt to a power of two of parts by a hash of its rows,
    and the one row of ``small`` goes to each part; rows of other keys are not copied.  The bound is the larger of ``HOT_ROWS`` and one row in ``HOT_SHARE``, so
    at most ``HOT_SHARE`` keys exceed it: with that proven bound hashes of them stand in the plan.  ``small``
    should be cheap to read, which happens up to four times.  Null keys of ``big`` join with nothing.
    """
    total, most = small.agg(F.coalesce(F.sum(rows), F.lit(0)), F.coalesce(F.max(rows), F.lit(0))).first()
    bound = max(HOT_ROWS, -(-int(total) // HOT_SHARE))
    power = F.ceil(F.log2(F.col(rows) / F.lit(bound))).cast("int")
    hot: dict[int, list[int]] = {}
    for h, p in small.filter(F.col(rows) > bound).select(F.xxhash64(*keys), power).collect() if most > bound else ():
        hot.setdefault(p, []).append(h)
    key = F.xxhash64(*keys)
    parts = F.lit(1)
    for p, hashes in hot.items():
        parts = F.when(key.isin(hashes), 1 << p).otherwise(parts)
    if hot:
        parts = F.when(key.isin([h for hashes in hot.values() for h in hashes]), parts).otherwise(F.lit(1))
    # the join has one form, whether or not a key is hot
    dealt = big.withColumn("_part", F.pmod(F.xxhash64(*big.columns), parts).cast("int"))
    first = small.withColumn("_part", F.pmod(key, F.lit(1)).cast("int"))
    others = small.filter(parts > 1).withColumn("_part", F.explode(F.sequence(F.lit(1), parts - 1)))
    copies = first.unionByName(others) if hot else first
    return dealt.hint("merge").join(copies, [*keys, "_part"], how).drop("_part")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
