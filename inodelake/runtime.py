"""Session, table loading, shared scratch tables and distributed ranking.

Everything that has to be cut from its lineage is written as Parquet below the
folder in ``spark.checkpoint.dir`` (all executors see it), so a lost executor
costs a task retry and never a recomputation of the whole chain.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(app: str = "inodelake", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; the path may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that Python gets at a time, but for a single row that has more.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, rows: int) -> None:
    """From now on the session hands Python at most ``rows`` rows and BATCH_BYTES at a time; smaller settings stay, if they are plain numbers."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, rows + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    most = re.fullmatch(r"(\d+)b?", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    if not most or int(most[1]) not in range(1, BATCH_BYTES + 1):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; below an own temporary folder only where that is unset and Spark runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = f"{(root or _own_folder()).rstrip('/')}/inodelake-{uuid.uuid4().hex}"
    _made.append(folder)
    return folder


#: The folders of this process, for ``clean``.
_made: list[str] = []


def clean() -> int:
    """Delete the scratch folders made so far, once the results that read them are saved; how many there were."""
    from pyarrow import fs

    n = 0
    while _made:
        store, path = fs.FileSystem.from_uri(_made.pop())
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)
            n += 1
    return n


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back: fixed rows, no lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(name: str, *taken: str) -> str:
    """``name``, with underscores added until no column in ``taken`` has it in any case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on ``keys``, still an equi-join for Spark."""
    cond = F.lit(True)
    for key in keys:
        cond = cond & left[key].eqNullSafe(right[key])
    return cond


def with_running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column | None, name: str) -> DataFrame:
    """Running sum of ``value`` (or count of rows) over the rows with equal ``keys``, by ``order``, up to and with each row.

    Two phases, so a key that holds any share of all rows is never sorted in one
    task: the rows are range-partitioned on keys and order, written with their
    partition number, summed inside (keys, partition), and shifted by the sums
    of the partitions before. Rows that tie in everything are kept apart by a
    running number, so equal rows can't pile up in a partition either.
    """
    tie, part, local, before, own, total = (free_name(n, name, *df.columns) for n in ("__tie", "__part", "__local", "__before", "__value", "__total"))
    placed = df.withColumn(tie, F.monotonically_increasing_id()).withColumn(own, (F.lit(1) if value is None else value).cast("long"))
    ranges = [*[F.col(k).asc_nulls_last() for k in keys], *order, F.col(tie)]
    placed = written(placed.repartitionByRange(*ranges).withColumn(part, F.spark_partition_id()), "ranked")
    sums = placed.groupBy(*keys, part).agg(F.sum(own).alias(total))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, part, F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy(*keys, part).orderBy(*order, F.col(tie)).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn(local, F.sum(own).over(inside))
    joined = summed.join(starts, same_keys(summed, starts, [*keys, part]))
    return joined.select(*[summed[c] for c in df.columns], (summed[local] + starts[before]).alias(name))


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Position from 1 of each row among the rows with equal ``keys``, by ``order``."""
    return with_running(df, keys, order, None, name)


def running_start(df: DataFrame, index: str, value: str, name: str, block: int = 1024) -> DataFrame:
    """Sum of ``value`` over the rows with a smaller ``index`` (a unique number from 0).

    Blocks of indices are summed first; only the block totals meet in one window.
    """
    blocked = df.withColumn("__block", F.expr(f"{index} div {block}"))
    totals = blocked.groupBy("__block").agg(F.sum(value).alias("__total"))
    earlier = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__block", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__from"))
    inside = Window.partitionBy("__block").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    summed = blocked.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(starts, "__block").withColumn(name, (F.col("__inside") + F.col("__from")).cast("long")).drop("__block", "__inside", "__from")
