"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import fresh

_own: dict[str, str] = {}
#: Folders of the tables written so far and not removed, oldest first.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (tests on one machine), a temporary folder, which is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="kestrace-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone; the shared folder is then cleaned by its owner
        pass


def materialise(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder: it outlives lost executors and is not computed again.

    The files go when the session's process ends. by: a column to split the table's folder by.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/kestrace-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    atexit.register(_remove, spark, path)
    return out


def _folders(df: DataFrame) -> set[str]:
    """The folders of materialised tables that df reads."""
    return {f.rsplit("/kestrace-", 1)[0] + "/kestrace-" + f.rsplit("/kestrace-", 1)[1].split("/")[0] for f in df.inputFiles() if "/kestrace-" in f}


def forget(df: DataFrame) -> None:
    """Deletes the files of a materialised table that no later plan reads."""
    for path in _folders(df):
        _remove(df.sparkSession, path)


def step(make: Callable[[], DataFrame]) -> DataFrame:
    """make's result, written out; the tables that were written on the way are removed."""
    mark = len(_written)
    out = materialise(make())
    for path in _written[mark:-1]:
        _remove(out.sparkSession, path)
    del _written[mark:-1]
    return out


#: Wanted keys are broadcast up to this many, about 16 bytes each.
BROADCAST_KEYS = 500_000
#: Slots of a filter at most, one bit each.
SLOTS = 1 << 26


def _slots(wanted: DataFrame) -> int:
    """A power of 2, at least 16 for each of wanted's rows as long as that is at most SLOTS."""
    return min(SLOTS, 1 << max(16, (16 * max(1, wanted.count())).bit_length()))


def slot_words(wanted: DataFrame) -> np.ndarray:
    """A bit for each of 2 ** k slots, which the lowest k bits of wanted's only column, a long, set: in all 8 MB at most."""
    slots, key = _slots(wanted), F.col(wanted.columns[0])
    slot = key.bitwiseAND(F.lit(slots - 1))
    got = wanted.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(slots // 64, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def matching(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is one of wanted's only column, distinct and written out.

    A few keys are broadcast. More are told by a broadcast filter of slots first, so that
    the shuffle that then decides carries little else than the rows asked for.
    """
    n = wanted.count()
    other = fresh(rows, "wanted_key")
    wanted = wanted.toDF(other)
    if n <= BROADCAST_KEYS:
        return rows.join(F.broadcast(wanted), F.col(key).eqNullSafe(F.col(other)), "left_semi")
    slots, word = _slots(wanted), fresh(rows, "slot_word")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{c}`), {slots}) & 63 as int))")
    words = wanted.groupBy(F.shiftright(slot(other), 6).alias(word)).agg(F.bit_or(bit(other)).alias(f"{word}_bits"))  # SLOTS / 64 rows at most
    near = rows.join(F.broadcast(words), (F.shiftright(slot(key), 6) == F.col(word)) & (F.col(f"{word}_bits").bitwiseAND(bit(key)) != 0), "left_semi")
    return near.join(wanted, F.col(key).eqNullSafe(F.col(other)), "left_semi")


#: Dropped rows are broadcast up to this many (about 40 bytes each), else joined by a shuffle.
BROADCAST_DROPPED = 250_000


def keep_rows(docs: DataFrame, decided: DataFrame, text_key: Callable[[Column], Column]) -> DataFrame:
    """docs, all its columns, without the rows that decided (doc_id, key, kept) does not keep.

    A row is told by its doc_id and text_key(text). Of rows repeated with both, one stays
    when one is kept.
    """
    one, two = fresh(docs, "dropped_id"), fresh(docs, "text_key")
    decided = materialise(decided.groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    dropped = decided.where(~F.col("kept")).select(F.col("doc_id").alias(one), F.col("key").alias(f"{two}_"))
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_DROPPED else dropped
    hashed = docs.withColumn(two, text_key(F.col("text").cast("string")))
    kept = hashed.join(dropped, (F.col(two) == F.col(f"{two}_")) & F.col("doc_id").cast("long").eqNullSafe(F.col(one)), "left_anti")
    if decided.where("kept and n > 1").limit(1).count():
        number = fresh(docs, "doc_number")
        kept = kept.withColumn(number, F.col("doc_id").cast("long")).dropDuplicates([number, two])
    return kept.select(*docs.columns)
