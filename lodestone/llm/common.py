"""Shared folder, tables and Arrow plumbing for the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words everywhere in this subpackage.
WORD_RE = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is
    unset, a temporary one on a single machine, and an error on a cluster."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        context.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _collectors:
        paths.append(path)
    return path


#: Lists that take the paths of scratch tables as they are made.
_collectors: list[list[str]] = []


@contextlib.contextmanager
def collected(paths: list[str]):
    """The paths of tables made inside go to the list, for drop_paths()."""
    _collectors.append(paths)
    try:
        yield
    finally:
        _collectors.pop()


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more, and empty the list."""
    while paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession | None = None) -> None:
    """Give back what the driver's Python has freed, since the C library keeps it
    otherwise; with a session, its JVM's part too: plans and broadcasts that nothing
    refers to any more."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError, TypeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)
    if spark is not None:
        spark._jvm.System.gc()


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Jobs inside drop their shuffle files when they end; nothing reads those again,
    since what is used twice is written to a table."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def saved(df: DataFrame, name: str, drop: tuple = ()) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there,
    and a lost executor costs no recomputation. Tables in `drop` go afterwards."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    for x in drop:
        remove(x)
    return out


def remove(df: DataFrame | None) -> None:
    """Delete a table written by saved()."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        drop_paths(df.sparkSession, [path])


def _slot(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def marks(keys: DataFrame, col: str, bits: int = 24) -> DataFrame:
    """A bitmap of 2^bits places with those of the keys set: at most 2^(bits - 6) rows,
    whatever the number of keys, so that it can be broadcast. Written to a table."""
    slot = keys.select(_slot(F.col(col), bits).alias("s"))
    words = slot.groupBy(F.shiftrightunsigned("s", 6).alias("_lode_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("_lode_bits"))
    return saved(words, "marks")


def maybe(df: DataFrame, key: Column, marked: DataFrame, bits: int = 24) -> tuple[DataFrame, Column]:
    """(df with a bitmap's column, condition): true for all rows whose key is among the
    marked ones, false for most others. The rows are not shuffled."""
    slot = _slot(key, bits)
    out = df.join(F.broadcast(marked), F.shiftrightunsigned(slot, 6) == F.col("_lode_word"), "left")
    bit = F.expr("shiftright(_lode_bits, cast(_lode_at & 63 as int)) & 1")
    return out.withColumn("_lode_at", slot).withColumn("_lode_maybe", F.coalesce(bit, F.lit(0)) == 1).drop("_lode_word", "_lode_bits", "_lode_at"), F.col("_lode_maybe")


def split_off(df: DataFrame, key: Column, keys: DataFrame, col: str, bits: int = 22) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is among `keys`, all others). Rows that a bitmap rules out are
    passed on as they are; only the rest are joined. Null keys are among the others.
    A full bitmap rules nothing out: then all rows are joined, with the same result."""
    marked = marks(keys.where(F.col(col).isNotNull()), col, bits)
    seen, hit = maybe(df.withColumn("_lode_key", key), F.col("_lode_key"), marked, bits)
    near, far = seen.where(hit).drop("_lode_maybe"), seen.where(~hit | F.col("_lode_key").isNull()).drop("_lode_maybe", "_lode_key")
    near = near.where(F.col("_lode_key").isNotNull())
    with_key = keys.select(F.col(col).alias("_lode_in")).where(F.col("_lode_in").isNotNull())
    chosen = near.join(with_key, F.col("_lode_key") == F.col("_lode_in"), "left_semi").drop("_lode_key")
    rest = near.join(with_key, F.col("_lode_key") == F.col("_lode_in"), "left_anti").drop("_lode_key")
    return chosen, far.unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % mod, F.lit(0))


def slices(lengths, most: int):
    """Row ranges whose texts add up to about `most` bytes, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths)


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The id of a row; rows without one get a number from their text, above all usual ids."""
    spare = F.shiftrightunsigned(F.xxhash64(docs[text_col]), 2) + F.lit(1 << 62)
    return F.coalesce(docs[id_col].cast("long"), spare)
