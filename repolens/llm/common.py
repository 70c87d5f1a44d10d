"""Shared helpers of the ``llm`` operators: session preparation, written
intermediate tables, size-checked broadcasts and distributed numbering."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

#: A table is broadcast only when it was counted and has at most so many rows.
BROADCAST_ROWS = 200_000
#: ASCII white space that separates words everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Checkpoint folder, package on the executors, small Arrow batches (a
    batch of long documents must fit a Python worker)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000),
                       ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        if int(spark.conf.get(key, None) or value + 1) > value:
            spark.conf.set(key, str(value))
    return spark


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, every other character unchanged."""
    return F.translate(c, _UPPER, _LOWER)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and not spark.sparkContext._jsc.sc().isStopped():
        for p in _written:
            _delete(spark, p)


def write_table(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write ``df`` as Parquet (with the writer's ``options``) under the shared
    checkpoint folder and read it back: the lineage ends there, so a lost executor costs no earlier stage.
    The folders of this process are deleted when it ends."""
    spark = df.sparkSession
    if not _written:
        atexit.register(_clean)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by ``write_table`` that no later plan
    reads."""
    for path in list(_written):
        tail = path.rsplit("/", 1)[1]
        if any(f"/{tail}/" in f for f in df.inputFiles()[:1]):
            _delete(df.sparkSession, path)
            _written.remove(path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows (counts no further)."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` behind a count; beyond the bound the plain frame, so
    that the join shuffles and adaptive execution splits skewed keys."""
    return F.broadcast(df) if is_small(df, rows) else df


def broadcast_if_light(df: DataFrame, lists: str, rows: int = BROADCAST_ROWS, items: int = 10 * BROADCAST_ROWS) -> DataFrame:
    """As ``broadcast_if_small``, for rows that hold a list: the lists' total
    length is bounded too."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.size(lists))).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= items else df


def number_rows(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: 0, 1, ... in ``order``.  Range partitions are numbered each
    by itself; only one count per partition goes to the driver."""
    d = write_table(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "numbered")
    starts, at = [], 0
    for p, n in sorted((r[0], r[1]) for r in d.groupBy("__p").count().collect()):
        starts += [F.lit(p), F.lit(at)]
        at += n
    if not starts:
        return d.drop("__p").withColumn(out, F.lit(0).cast("long"))
    w = Window.partitionBy("__p").orderBy(*order)
    return (d.withColumn(out, F.row_number().over(w) - 1 + F.create_map(*starts)[F.col("__p")])
            .withColumn(out, F.col(out).cast("long")).drop("__p"))
