"""Calls of a user's function that are not repeated.

Each distinct prompt is called once.  Its answer goes into a ledger, a folder
of Parquet files ``(digest, answer, error, run)`` that the tasks themselves
add to while they work, so what has been answered stays answered: a run
that is killed, and a task whose executor is lost, repeat only the calls of the last
unwritten chunk.  Before calling, the prompts are anti-joined with the ledger
on their digests; calls that failed are made again by the next run.

A change set has at most ``max_concurrent`` calls in flight: its calls are
dealt to slots, a slot is one task's, and a task keeps ``in_flight`` calls of
its event loop open.  ``fn`` is a function or a coroutine function.
"""

from __future__ import annotations

import asyncio
import inspect
import uuid
from collections.abc import Awaitable, Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PY_WHITESPACE
from ..sources.files import open_tree, qualified
from .summarize import FILE_PROMPT, MAX_CONCURRENT, batch_prompt, first_words

LEDGER_SCHEMA = "digest string, answer string, error string, run string"
_ARROW = pa.schema([(c, pa.string()) for c in ("digest", "answer", "error", "run")])
#: Answers that a task holds at most before it writes them.
WRITE_EVERY = 16


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """``digest, answer, error, run`` of every finished call; no rows where
    the folder is new (it is made)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    return spark.read.schema(LEDGER_SCHEMA).option("recursiveFileLookup", "true").parquet(ledger)


class _Book:
    """One task's part of the ledger: files of whole chunks."""

    def __init__(self, uri: str, run: str, write_every: int):
        self.tree, base = open_tree(uri)
        self.folder, self.run, self.write_every = f"{base}/run-{run}", run, write_every
        self.tree.create_dir(self.folder, recursive=True)
        self.part = f"part-{TaskContext.get().partitionId()}-"
        self.held: list[tuple] = []

    def finished(self) -> set[str]:
        """Digests that earlier attempts of this task have written."""
        files = [x.path for x in self.tree.get_file_info(pafs.FileSelector(self.folder)) if x.base_name.startswith(self.part)]
        return {d for f in files for d in pq.read_table(f, filesystem=self.tree, columns=["digest"]).column(0).to_pylist()}

    def add(self, digest: str, answer: str | None, error: str | None) -> None:
        self.held.append((digest, answer, error, self.run))
        if len(self.held) >= self.write_every:
            self.write()

    def write(self) -> None:
        if self.held:
            # Readers skip names that begin with "_"; a chunk appears whole.
            name = f"{self.part}{uuid.uuid4().hex}.parquet"
            table = pa.Table.from_arrays([pa.array(c, pa.string()) for c in zip(*self.held)], schema=_ARROW)
            pq.write_table(table, f"{self.folder}/_{name}", filesystem=self.tree)
            self.tree.move(f"{self.folder}/_{name}", f"{self.folder}/{name}")
            self.held = []


async def _answer_all(fn, rows: list[tuple[str, str]], book: _Book, in_flight: int, pool: ThreadPoolExecutor) -> None:
    gate, loop = asyncio.Semaphore(in_flight), asyncio.get_running_loop()

    async def one(digest: str, prompt: str) -> None:
        async with gate:
            try:
                out = await (fn(prompt) if inspect.iscoroutinefunction(fn) else loop.run_in_executor(pool, fn, prompt))
                answer, error = (out.strip(PY_WHITESPACE) if out is not None else None), None
            except Exception as e:  # noqa: BLE001 -- a failed call is a value
                answer, error = None, str(e)
            book.add(digest, answer, error)

    await asyncio.gather(*(one(d, p) for d, p in rows))


def _caller(fn, uri: str, run: str, in_flight: int, write_every: int):
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = _Book(uri, run, write_every)
        done, n = None, 0
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                done = book.finished() if done is None else done
                rows = [r for r in zip(batch.column("digest").to_pylist(), batch.column("prompt").to_pylist()) if r[0] not in done]
                asyncio.run(_answer_all(fn, rows, book, in_flight, pool))
                n += len(rows)
        book.write()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["calls"])
    return call


def call_batches(batches: DataFrame, ledger: str, fn: Callable[[str], str | None | Awaitable[str | None]] = first_words,
                 template: str = FILE_PROMPT, key: str = "change_set", max_concurrent: int = MAX_CONCURRENT,
                 in_flight: int = 2, write_every: int = WRITE_EVERY) -> DataFrame:
    """I1 through a ledger: the rows of ``map_batches``, with one call for
    each distinct prompt that no earlier run has answered.  ``ledger`` is a
    folder that all executors share; prompts of another model belong into another
    one.  A null key is a change set; a null prompt is not called and has a
    null summary.  Runs when it is called (the calls are the work); the
    returned rows are a join of batches and ledger."""
    spark = batches.sparkSession
    if not 1 <= in_flight <= max_concurrent:
        raise ValueError("in_flight must be between 1 and max_concurrent")
    run = uuid.uuid4().hex
    b = batches.select(key, "batch_no", F.transform("members", lambda m: m["path"]).alias("files"), batch_prompt(template).alias("prompt"))
    b = b.withColumn("digest", F.sha2("prompt", 256)).checkpoint(eager=True)
    answered = read_ledger(spark, ledger).where(F.col("error").isNull()).select("digest")
    todo = b.where(F.col("prompt").isNotNull()).groupBy("digest").agg(F.min(F.struct(F.col(key).alias("k"), "batch_no", "prompt")).alias("c"))
    todo = todo.join(answered, "digest", "left_anti").select("digest", "c.prompt", F.col("c.k").alias("k"),
                                                             (F.col("c.batch_no") % (max_concurrent // in_flight)).alias("slot"))
    work = todo.repartition("k", "slot").select("digest", "prompt")
    work.mapInArrow(_caller(fn, qualified(spark, ledger), run, in_flight, write_every), "calls bigint").agg(F.sum("calls")).collect()
    # An answer of any run counts, of two the smallest; else this run's error.
    told = (read_ledger(spark, ledger).groupBy("digest")
            .agg(F.bool_or(F.col("error").isNull()).alias("ok"), F.min("answer").alias("answer"), F.min(F.when(F.col("run") == run, F.col("error"))).alias("e")))
    told = told.select(F.col("digest").alias("d"), "answer", F.when(~F.col("ok"), F.col("e")).alias("e"))
    return (b.select(key, "batch_no", "files", "digest").join(told, F.col("digest") == F.col("d"), "left")
            .select(key, "batch_no", "files", F.col("answer").alias("summary"), F.col("e").alias("error")))
