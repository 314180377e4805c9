"""What the corpus operators share: the shared folder, staged tables, bounded Arrow batches and what a worker keeps."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir, or (unset, as in tests) one temp folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="strandline-"))
            atexit.register(shutil.rmtree, _own[0], True)
        named = "file://" + _own[0]
    return named.rstrip("/") + "/strandline"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes `df` as a table in the shared folder and reads it back (its folder is `.staged_at`)."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | str | None) -> None:
    """Deletes staged tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        path = table if isinstance(table, str) else getattr(table, "staged_at", None)
        if path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a table's files (compressed) for one task of a shuffle that moves texts, and the most tasks of one.
TASK_BYTES, MOST_TASKS = 32 << 20, 100_000


def dealt(df: DataFrame, *keys, tasks: int | None = None) -> DataFrame:
    """`df` dealt to ranges of `keys`, to as many tasks as the session says, or more where the table's size asks for it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    by_size = 0 if size >= 1 << 60 else min(MOST_TASKS, -(-size // TASK_BYTES))  # beyond: Spark's mark of an unknown size
    n = max(tasks or 0, by_size)
    return df.repartitionByRange(n, *keys) if n > partitions(df.sparkSession) else df.repartitionByRange(*keys)


#: Text, ids and what is made of them for one Arrow batch stay within a few times this.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session get a bound in bytes (their bound in rows alone lets long texts fill any memory).
    A smaller bound that is set already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark._jsparkSession.sessionState().conf().getConfString(key).lower().removesuffix("b")
    if not known.isdigit() or not 0 < int(known) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


class WordCache(dict):
    """word -> make(word), a number or a short list, computed on a miss; forgotten when words and values take about
    `limit` bytes. Long words are never held."""

    #: Of a dictionary's slot and the headers of a string and a value.
    EACH = 220

    def __init__(self, make, limit: int = 32 << 20, longest: int = 64):
        self.make, self.limit, self.longest, self.size = make, limit, longest, 0

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= self.longest:
            self.size += self.EACH + len(word) + 8 * (len(value) if isinstance(value, (list, tuple)) else 1)
            if self.size > self.limit:
                self.clear()
                self.size = 0
            self[word] = value
        return value


_held: dict[str, tuple[object, object]] = {}


def held(name: str, make):
    """What make() gave for `name`, kept in this worker process for its next tasks. When another stage asks for
    something first, what stages before it used goes, and its memory goes back to the system: a worker that serves many
    operators holds the models and caches of one."""
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage is not None and (old := [k for k, (s, _) in _held.items() if s != stage and k != name]):
        for k in old:
            del _held[k]
        release()
    value = _held[name][1] if name in _held else make()
    _held[name] = (stage, value)
    return value


def release() -> None:
    """Hands freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def tokenizer_path(name: str) -> str:
    """A vocabulary file's place on this machine (every executor has the public_tokenizers package)."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
