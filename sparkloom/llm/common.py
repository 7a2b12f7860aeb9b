"""Shared helpers: where intermediate tables go, reading inputs, bounded caches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that are shown to be no larger are broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's spark.checkpoint.dir. Only in local mode, where there is one machine, an unset value is replaced by a folder made here.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set; a cluster needs a shared folder for intermediate tables")
    made = getattr(context, "_sparkloom_dir", None)
    if made is None:
        made = context._sparkloom_dir = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return made


#: Spark's switch for deleting a query's shuffle files when the query ends; else they stay until the driver happens to collect its garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def swept(spark: SparkSession):
    """Queries begun within delete their shuffle files when they end. That is right for writes, which run once."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SWEEP)
        else:
            spark.conf.set(SWEEP, before)


def written(df: DataFrame) -> DataFrame:
    """The same rows, from a table in the shared folder.

    This cuts the lineage: a lost executor costs at most the running stage. The shuffles that made the table go with its last row, its files when the session's file
    system closes, or by scratch() or drop_written().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{uuid.uuid4().hex}"
    with swept(spark):
        df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    if _scratch:
        _scratch[-1].append(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = at
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables that written() returned and that nothing reads any more."""
    for df in tables:
        df._written_at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(df._written_at, True)


#: The tables written in each running function that scratch() wraps.
_scratch: list[list] = []


def scratch(made):
    """made, a function that returns a DataFrame, whose result is written; the tables that it wrote on the way are then deleted."""

    @functools.wraps(made)
    def run(*args, **options) -> DataFrame:
        paths: list = []
        _scratch.append(paths)
        try:
            out = made(*args, **options)
        finally:
            _scratch.pop()
        kept = written(out)
        conf = kept.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for at in paths:
            at.getFileSystem(conf).delete(at, True)
        return kept

    return run


def few(rows: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The rows, to be broadcast if they are shown to take so many bytes at most, as JSON and 32 for each row; else a join shuffles. rows is read for that, so it should be a written table or a small plan."""
    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 32)).first()[0] or 0
    return F.broadcast(rows) if size <= most else rows


#: Keys of more than one in so many rows are hot; there are no more of them than that. Keys of LEAST_HOT rows aren't.
HOT_KEYS, LEAST_HOT = 20_000, 200


def join_counted(rows: DataFrame, counted: DataFrame, key: str, total: int, by: str) -> DataFrame:
    """rows joined with counted (key, c, ..), each key once, where c says how many of the total rows have it; counted should be written.

    Rows of a hot key are dealt to several tasks by a hash of the column by, and the row of counted is repeated for each. Only hot keys and their numbers of parts are broadcast.
    """
    limit = max(total // HOT_KEYS, LEAST_HOT)
    parts, part = free([*rows.columns, *counted.columns], "parts", "part")
    counted = counted.withColumn(parts, F.greatest(F.ceil(F.col("c") / limit), F.lit(1)).cast("int"))
    hot = F.broadcast(counted.where(F.col(parts) > 1).select(key, parts))
    dealt = rows.join(hot, key, "left").withColumn(part, F.pmod(F.xxhash64(by), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    repeated = counted.withColumn(part, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts)
    return dealt.join(repeated, [key, part]).drop(part)


#: Bits of a membership table, and those of one of its rows.
MEMBER_BITS, ROW_BITS = 1 << 27, 1 << 15


def member_bit(*columns: str | Column) -> Column:
    """Where a key stands in a membership table."""
    return F.pmod(F.xxhash64(*columns), F.lit(MEMBER_BITS))


def membership(keys: DataFrame) -> bytes:
    """A table of MEMBER_BITS bits, of which those of keys (bit long; see member_bit()) are set: 16 MB, whatever the number of keys. Other keys may share their bits, so what it lets through needs another test."""
    rows = keys.select(F.floor(F.col("bit") / ROW_BITS).alias("row"), (F.col("bit") % ROW_BITS).alias("at")).groupBy("row").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = bytearray(MEMBER_BITS // 8)
    for r in rows.toLocalIterator():
        out[r.row * (ROW_BITS // 8) : (r.row + 1) * (ROW_BITS // 8)] = r.bits
    return bytes(out)


def keys_of(docs: DataFrame) -> list[Column]:
    """What tells documents apart: the id as a string, empty for null, and a hash of the text, null for null."""
    text = docs["text"].cast("string")
    return [F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.when(text.isNotNull(), F.xxhash64(text))]


def keyed(docs: DataFrame) -> DataFrame:
    """d and h, see keys_of(), and text of each row that has a text. Rows with the same d and h are the same document."""
    d, h = keys_of(docs)
    return docs.select(d.alias("d"), h.alias("h"), docs["text"].cast("string").alias("text")).where("text IS NOT NULL")


def free(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores added until none is one of columns or of the names before it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(column):
    """Lower-cases A-Z and nothing else. lower() does that for texts of ASCII characters alone and is much faster than translate()."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, upper, upper.lower()))


def tidy(run):
    """run, a function from batches to batches, that gives memory back to the system when it ends: a worker lives on, and the next stage's work may be done by another process."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


class Cache(dict):
    """A dict that makes missing values; trim() empties it once it is over its bound."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
