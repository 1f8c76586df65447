"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits for each row that split() looks for, bits of all its bitmaps at most, and of one (bitmap_construct_agg's).
BITS, MOST_BITS, PAGE = 32, 1 << 27, 32_768

_own_dirs: dict[str, str] = {}
_written: list[tuple[SparkSession, str, DataFrame]] = []
#: With this Spark deletes a query's shuffle files when the query ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and there are no
    executors on other machines (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
    return _own_dirs[app]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors lose nothing. Its
    shuffles are not read again and go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _written.append((spark, path, spark.read.schema(df.schema).parquet(path)))
    return _written[-1][2]


def written() -> int:
    """How many tables materialize() has written and not yet deleted."""
    return len(_written)


def release(since: int = 0, last: int = 0, keep: tuple = ()) -> None:
    """Delete the tables that materialize() wrote after the first `since`, but for the `last` ones and the frames in
    `keep`; frames that read them end with this."""
    old = _written[since : len(_written) - last]
    stay = [any(w[2] is k for k in keep) for w in old]
    _written[since : len(_written) - last] = [w for w, s in zip(old, stay) if s]
    for spark, path in [w[:2] for w, s in zip(old, stay) if not s]:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            continue


atexit.register(release)


def text_of(df: DataFrame):
    """The text column, null as empty."""
    return F.coalesce(df["text"], F.lit(""))


def as_struct(df: DataFrame):
    """The whole row as one column, doc, so that no other name can clash with its columns."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc")


def split(rows: DataFrame, some: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows (doc, doc_id, key) that may be among some (doc_id, key), all that are and few others, and those that are not.
    Told apart where they lie, by bitmaps of hashes, so that most texts are in no shuffle, however many `some` are;
    beyond MOST_BITS more of the others are taken for possible."""
    hashed = lambda: F.xxhash64("doc_id", key)
    bits = max(PAGE, min(MOST_BITS, PAGE * -(-BITS * some.count() // PAGE)))
    bit = F.pmod(hashed(), F.lit(bits))
    pages = some.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / PAGE).alias("_page")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(PAGE))).alias("_map"))
    seen = rows.withColumn("_bit", bit).withColumn("_page", F.floor(F.col("_bit") / PAGE)).join(F.broadcast(pages), "_page", "left")
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_bit % 32768 div 8 + 1 as int), 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))
    return seen.filter(hit).select(rows.columns), seen.filter(~hit).select(rows.columns)


def _among(rows: DataFrame, some: DataFrame, key: str, how: str) -> DataFrame:
    some = some.select(F.col("doc_id").alias("_id"), F.col(key).alias("_key"))
    return rows.join(some, rows["doc_id"].eqNullSafe(some["_id"]) & (rows[key] == some["_key"]), how)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows (doc, doc_id, key) but those of gone (doc_id, key); null ids are equal."""
    possible, others = split(rows, gone, key)
    return others.unionByName(_among(possible, gone, key, "left_anti"))


def once(rows: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """One row each of those of again (doc_id, key), counted before they meet; all other rows as they are."""
    if again.isEmpty():
        return rows
    possible, others = split(rows, again, key)
    one = _among(possible, again, key, "left_semi").groupBy("doc_id", key).agg(F.first("doc").alias("doc"))
    return others.unionByName(_among(possible, again, key, "left_anti")).unionByName(one.select(rows.columns))


def first_of_groups(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """Of each group one row of docs: that with the smallest doc_id (null ids last, then the smaller key), one of
    equal rows. rooted: doc_id, key (xxhash64 of the text), times, root. Only ids and keys are grouped; texts meet the
    ids of the rows that go."""
    since = written()
    low = rooted.groupBy("root").agg(F.count("*").alias("members"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("low"))
    groups = materialize(low.filter("members > 1").select("root", F.col("low.doc_id").alias("low_id"), F.col("low.key").alias("low_key")), "groups")
    other = ~(F.col("doc_id").eqNullSafe(F.col("low_id")) & (F.col("key") == F.col("low_key")))
    gone = materialize(rooted.join(groups, "root").filter(other).select("doc_id", "key"), "gone")
    again = materialize(rooted.filter("times > 1").select("doc_id", "key"), "again")
    release(since, keep=(gone, again))
    rows = docs.select(as_struct(docs), F.col("doc_id"), F.xxhash64(text_of(docs)).alias("key"))
    return once(without(rows, gone, "key"), again, "key").select("doc.*")


_kept: list[tuple] = []


def kept(key, build=lambda: None):
    """What a worker process keeps from one task to the next: one operator's state at a time. When another operator's
    task begins, the state before it goes and its memory is given back."""
    if not _kept or _kept[0][0] != key:
        _kept.clear()
        tidy()
        _kept.append((key, build()))
    return _kept[0][1]


def tidy() -> None:
    """Give memory that is no longer used back to the system; allocators hold on to it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidied(run):
    """A function over Arrow batches that begins without another operator's state, and gives memory back at its end."""

    def wrapped(batches):
        kept(__name__)
        yield from run(batches)
        tidy()

    return wrapped
