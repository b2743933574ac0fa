"""Shared-folder staging: tables that cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one of our own if all tasks run in this process, as in tests, else an error."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillspan-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/quillspan-{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_drop_all)
    _MADE.append((spark, path))
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table made by written() that no later step reads."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/quillspan-" in path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all() -> None:
    for spark, path in _MADE:
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001 - the session may be gone at exit
                return


def input_bytes(df: DataFrame) -> int:
    """Size of df by the optimizer's statistics (file sizes for scans), without a job; its strings are measured where these know nothing."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    size = int(str(stats.sizeInBytes()))
    if size < 1 << 50:
        return size
    strings = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    return int(df.select(sum(strings, F.lit(8 * len(df.columns))).alias("n")).agg(F.sum("n")).first()[0] or 0)


def partitions_for(df: DataFrame, bytes_each: int, least: int = 1, growth: float = 1.0) -> int:
    """Partitions so that each holds about bytes_each of df's (growth times larger) data."""
    return max(least, int(input_bytes(df) * growth / bytes_each) + 1)


def sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """So many rows of df, or all if it has fewer: the first by a hash of some columns, ties in any order.

    Rows are first thinned to some twice as many by that hash, so that what is sorted doesn't grow with df.
    """
    total = df.count()
    mark = F.xxhash64(*[F.col(c).cast("string") for c in by])
    share = (2 * rows + 1000) / max(1, total)
    few = df if share >= 1 else df.where(mark < F.lit(int(2**64 * share) - 2**63))
    if share < 1 and few.isEmpty():  # nearly all rows are alike
        few = df
    return few.orderBy(mark).limit(rows).repartition(max(1, rows // 500))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df with a broadcast hint if it has that many (narrow) rows at most; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs but for the rows whose id is in ids' first column; null ids stay."""
    gone = small(written(ids.select(F.col(ids.columns[0]).cast("long").alias("__gone")).distinct(), "gone"))
    return docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
