"""File trees as tables, with every name.

Spark's own file listing hides names that begin with ``_`` or ``.``; source
trees are full of them.  Here directories are listed in tasks, one level of
the tree a round: the driver only learns how many directories are left.  File
names are matched and directories pruned while they are listed.  The files
found are packed into partitions by bytes (a running sum of their sizes), so
that a partition holds many small files or a few large ones, and read in
tasks; what cannot be read or is not UTF-8 is a row with an error.

Trees are opened with ``pyarrow.fs`` (local and mounted folders, S3, GCS,
HDFS where its native library is installed).  Links to directories are not
followed.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Directories that a task lists at most, bytes of a partition of files (each
#: file counts OPEN_BYTES more), bytes of a batch that a task hands over.
DIRS_PER_TASK, PARTITION_BYTES, OPEN_BYTES, BATCH_BYTES = 1000, 64 << 20, 64 << 10, 16 << 20
#: The largest text of a table cell.
MAX_BYTES = (1 << 31) - (1 << 20)


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` with its file system's scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def open_tree(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified root and the root's path in it."""
    scheme, _, path = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + path.lstrip("/")
    try:
        return pafs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"no file system for {scheme}: here ({e}); names='visible' reads it with Spark's listing") from e


def _alternatives(glob: str) -> list[str]:
    """A pattern without braces for each choice of ``{a,b}``."""
    m = re.search(r"\{([^{}]*)\}", glob)
    if m is None:
        return [glob]
    return [x for choice in m.group(1).split(",") for x in _alternatives(glob[:m.start()] + choice + glob[m.end():])]


def _lister(uri: str, glob: str | None, skip_dirs: Iterable[str]):
    patterns, skip = _alternatives(glob) if glob else None, set(skip_dirs)

    def run(batches):
        tree, base = open_tree(uri)
        local = isinstance(tree, pafs.LocalFileSystem)
        for batch in batches:
            out = []
            for rel in batch.column(0).to_pylist():
                for x in tree.get_file_info(pafs.FileSelector(f"{base}/{rel}" if rel else base, allow_not_found=bool(rel))):
                    name = x.base_name
                    path = f"{rel}/{name}" if rel else name
                    if x.type == pafs.FileType.Directory:
                        if name not in skip and not (local and os.path.islink(x.path)):
                            out.append((path, True, 0))
                    elif x.type == pafs.FileType.File and (patterns is None or any(fnmatch.fnmatchcase(name, p) for p in patterns)):
                        out.append((path, False, x.size))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.bool_()),
                                              pa.array([r[2] for r in out], pa.int64())], names=["path", "is_dir", "size"])
    return run


def list_files(spark: SparkSession, root: str, glob: str | None = None, skip_dirs: Iterable[str] = ()) -> DataFrame:
    """``(path, size)`` of every file below ``root``, with paths relative to
    it.  ``glob`` is matched against file names, directories named in
    ``skip_dirs`` are not entered.  An empty tree gives no rows; a root that
    does not exist is an error."""
    run = _lister(qualified(spark, root), glob, skip_dirs)
    dirs, left, found = spark.createDataFrame([("",)], "path string"), 1, []
    while left:
        tasks = min(left, max(spark.sparkContext.defaultParallelism, -(-left // DIRS_PER_TASK)))
        level = dirs.repartition(tasks).mapInArrow(run, "path string, is_dir boolean, size bigint").checkpoint(eager=True)
        found.append(level.where(~F.col("is_dir")).select("path", "size"))
        dirs = level.where("is_dir").select("path")
        left = dirs.count()
    return reduce(DataFrame.unionAll, found)


def pack_by_bytes(df: DataFrame, size: Column, order: str, target: int = PARTITION_BYTES) -> DataFrame:
    """``df`` dealt into partitions of about ``target`` bytes: rows are
    numbered by a running sum of ``size``, which is counted in each present
    partition by itself; the driver only gets one sum a partition.  Pass
    narrow rows; they are written once."""
    d = df.withColumn("_size", size.cast("bigint")).withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)
    starts, at = [], 0
    for part, total in sorted((r[0], r[1]) for r in d.groupBy("_part").agg(F.sum("_size")).collect()):
        starts += [F.lit(part), F.lit(at).cast("bigint")]
        at += total
    if not starts:
        return df
    before = F.sum("_size").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    pack = F.floor((F.create_map(*starts)[F.col("_part")] + before) / F.lit(target)).cast("int")
    return d.withColumn("_pack", pack).repartitionById(at // target + 1, F.col("_pack")).select(*df.columns)


def _reader(uri: str, decode_error: str):
    def run(batches):
        tree, base = open_tree(uri)
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["path", "content", "error"])

        for paths in batches:
            for path, size in zip(paths.column(0).to_pylist(), paths.column(1).to_pylist()):
                content, error = None, None
                if size > MAX_BYTES:
                    error = f"larger than {MAX_BYTES} bytes"
                else:
                    try:
                        with tree.open_input_stream(f"{base}/{path}", compression=None) as f:
                            content = f.read().decode("utf-8")
                    except UnicodeDecodeError:
                        error = decode_error
                    except OSError as e:
                        error = str(e)
                if rows and held + size > BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
                rows.append((path, content, error))
                held += size
        if rows:
            yield batch()
    return run


def read_files(spark: SparkSession, root: str, files: DataFrame, decode_error: str = "not valid UTF-8") -> DataFrame:
    """``(path, content, error)`` of the rows of ``list_files``."""
    dealt = pack_by_bytes(files.select("path", "size"), F.col("size") + OPEN_BYTES, "path")
    return dealt.mapInArrow(_reader(qualified(spark, root), decode_error), "path string, content string, error string")


def _writer(uri: str):
    def run(batches):
        tree, base = open_tree(uri)
        made = set()
        for batch in batches:
            n = size = 0
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path is None or ".." in path.split("/"):
                    raise ValueError(f"not a path below the root: {path}")
                data, folder = (content or "").encode(), path.rpartition("/")[0]
                if folder not in made:
                    tree.create_dir(f"{base}/{folder}", recursive=True)
                    made.add(folder)
                with tree.open_output_stream(f"{base}/{path}", compression=None) as f:
                    f.write(data)
                n, size = n + 1, size + len(data)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([size])], names=["n", "size"])
    return run


def write_files(df: DataFrame, root: str, path_col: str = "path", content_col: str = "content") -> tuple[int, int]:
    """Writes each row's content (null as empty) to its path below ``root``
    and returns the numbers of files and bytes.  A task that runs again writes
    the same files again."""
    spark = df.sparkSession
    done = df.select(F.col(path_col), F.col(content_col)).mapInArrow(_writer(qualified(spark, root)), "n bigint, size bigint")
    n, size = done.agg(F.sum("n"), F.sum("size")).first()
    return n or 0, size or 0
