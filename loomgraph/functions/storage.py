"""Tables in the cluster's shared folder: they cut the lineage of loops and survive lost executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []
BROADCAST_ROWS = 500_000
TASK_ROWS = 500_000  #: rows of a join or an aggregate that parts() gives a task


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode, as in tests, a temporary one of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="loomgraph-"))
    return _own[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(drop_written)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more, so that a loop keeps no more than its last round, and let Spark clear
    what was shuffled for them."""
    for df in tables:
        names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
        for item in [x for x in _written if x[1].rpartition("/")[2] in names]:
            _written.remove(item)
            _delete(*item)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()  # shuffles go when their tables are collected


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_written() -> None:
    """Delete the tables made by written(); called when the driver ends."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit; the folder is then the cluster's to clear
            return


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows; reads no more than it must."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """df by keys over a stated number of partitions, for groups that cost far more than their bytes say: adaptive execution would put
    many of them in one task. rows: how many there may be, where that is known, so that no task gets too many."""
    return df.repartition(max(parts(df, rows), df.sparkSession.sparkContext.defaultParallelism), *keys)


def laid_out(df: DataFrame, *keys: str) -> DataFrame:
    """df kept on the executors by keys over the session's partitions, for rounds that join it by these keys: only the other side moves
    then, and sums of what comes out meet in few places. The caller ends it by unpersist()."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).persist()


def parts(df: DataFrame, rows: int) -> int:
    """Partitions for that many rows: the session's number at least, more where a task would get over TASK_ROWS."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def numbered(df: DataFrame, *order: str, name: str = "id", first: int = 1, rows: int = 0) -> DataFrame:
    """df with dense numbers in the given order, without a single-task window: places in sorted partitions plus offsets.

    rows: how many there may be, where that is known, so that none of the sorted partitions is large.
    """
    at = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(parts(df, rows), *order).sortWithinPartitions(*order) if rows else df.orderBy(*order)
    place = written(ordered.withColumn("_part", F.shiftright(at, 33)).withColumn("_row", at.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = sorted((r["_part"], r["count"]) for r in place.groupBy("_part").count().collect())
    offsets, total = [], first
    for part, count in sizes:
        offsets.append((part, total))
        total += count
    spark = df.sparkSession
    table = spark.createDataFrame(offsets, "_part long, _first long")
    return place.join(F.broadcast(table), "_part").withColumn(name, F.col("_row") + F.col("_first")).drop("_part", "_row", "_first")
