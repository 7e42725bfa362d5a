"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each partition hashes its texts, drops what repeats inside it and sends every owner one
message: the sorted distinct fingerprints of the owner's range, Golomb-Rice coded. An
owner answers each message with a bitmap of the fingerprints that other partitions also
sent. Rows marked by a bitmap, or repeated inside their partition, are suspects; only
their texts are shuffled, and their bytes make the groups. A text travels once for each map
task, however many copies a partition holds, so one text may be a third of the rows. Rows
find their group by a key, the first KEY_BYTES of the digest; where texts of one key differ,
their rows are matched by the bytes themselves.

Defined results: null text counts as empty; texts are equal when they are identical after
lower-casing A-Z, very long ones too, byte by byte; the row with the largest doc_id stays
(null ids are smallest); among repeated rows of that id one stays. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep_rows, matching, materialise
from .text import blocks, id_text

FINGERPRINT_BITS = 40
#: Rows that a partition holds before it sends its messages.
ROWS_A_SENDER = 1_000_000
#: Fingerprints, about, that an owner receives.
ROWS_AN_OWNER = 2_000_000
KEY_BYTES = 16


def encode(values: np.ndarray) -> bytes:
    """Golomb-Rice code of ascending distinct numbers: count, k, unary quotients, k-bit remainders."""
    if not len(values):
        return b""
    gap = np.diff(values, prepend=np.int64(0))
    k = max(0, int(np.log2(max(1.0, gap.mean() * 0.6931))))
    quotient = gap >> k
    unary = np.zeros(int(quotient.sum()) + len(gap), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    rest = ((gap[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    head = np.array([len(gap), k, len(unary)], np.int64).tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def decode(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.int64)
    n, k, bits = np.frombuffer(blob[:24], np.int64)
    cut = 24 + (bits + 7) // 8
    unary = np.unpackbits(np.frombuffer(blob[24:cut], np.uint8), count=bits)
    quotient = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(blob[cut:], np.uint8), count=n * k).reshape(n, k).astype(np.int64)
    return np.cumsum((quotient << k) + rest @ (np.int64(1) << np.arange(k, dtype=np.int64)))


def _senders(owners: int):
    width = -(-(1 << FINGERPRINT_BITS) // owners)

    def flush(ids: list, digests: list[bytes], pid: int) -> Iterator[pa.RecordBatch]:
        raw = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 4)[:, 0]
        fp = (raw >> np.uint64(64 - FINGERPRINT_BITS)).astype(np.int64)
        value, rank, count = np.unique(fp, return_inverse=True, return_counts=True)
        owner = value // width
        cut = np.searchsorted(owner, np.arange(owners + 1))
        rows = len(ids)
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array(np.zeros(rows, np.int32)), "pid": pa.array(np.full(rows, pid)), "owner": pa.array(owner[rank].astype(np.int32)),
            "rank": pa.array(rank - cut[owner[rank]]), "row": pa.array(np.arange(rows)), "doc_id": pa.array(ids, pa.int64()), "digest": pa.array(digests, pa.binary()),
            "again": pa.array(count[rank] > 1), "message": pa.nulls(rows, pa.binary()),
        })
        sent = np.flatnonzero(np.diff(cut))
        n = len(sent)
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array(np.ones(n, np.int32)), "pid": pa.array(np.full(n, pid)), "owner": pa.array(sent.astype(np.int32)), "rank": pa.nulls(n, pa.int64()), "row": pa.nulls(n, pa.int64()),
            "doc_id": pa.nulls(n, pa.int64()), "digest": pa.nulls(n, pa.binary()), "again": pa.nulls(n, pa.bool_()), "message": pa.array([encode(value[cut[o] : cut[o + 1]]) for o in sent], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        digests: list[bytes] = []
        pid = sender = 0
        for batch in batches:
            pid = batch.column("part")[0].as_py() if batch.num_rows else pid
            ids += batch.column("doc_id").to_pylist()
            for _, texts in blocks(batch):
                digests += [hashlib.sha256(t.lower()).digest() for t in texts]
            if len(ids) >= ROWS_A_SENDER:
                yield from flush(ids, digests, pid << 20 | sender)
                ids, digests, sender = [], [], sender + 1
        if ids:
            yield from flush(ids, digests, pid << 20 | sender)

    return run


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    """For each message a bitmap of the fingerprints that another message has too."""
    lists = [decode(m) for m in messages["message"]]
    value, count = np.unique(np.concatenate(lists), return_counts=True)
    twice = value[count > 1]
    maps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in lists]
    return messages[["pid", "owner"]].assign(bitmap=maps)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pid, owner, bitmap in zip(*(batch.column(c).to_pylist() for c in ("pid", "owner", "bitmap")), strict=True):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8)))
            yield pa.RecordBatch.from_pydict({"pid": pa.array(np.full(len(at), pid)), "owner": pa.array(np.full(len(at), owner, np.int32)), "rank": pa.array(at)})


def normalised(column):
    """A-Z in lower case, nothing else."""
    return F.translate(F.coalesce(column, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_groups(docs: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    spark = docs.sparkSession
    rows = id_text(docs)
    # As many owners as the fingerprints need, and no fewer than a shuffle has tasks.
    owners = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_AN_OWNER))
    schema = "kind int, pid long, owner int, rank long, row long, doc_id long, digest binary, again boolean, message binary"
    sent = materialise(rows.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_senders(owners), schema), by="kind")
    messages = sent.where("kind = 1").select("pid", "owner", "message")
    hashed = sent.where("kind = 0").select("pid", "owner", "rank", "row", "doc_id", "digest", "again")
    bitmaps = messages.groupBy("owner").applyInPandas(_answer, "pid long, owner int, bitmap binary")
    marks = bitmaps.mapInArrow(_marked, "pid long, owner int, rank long").withColumn("hit", F.lit(True))
    seen = hashed.join(marks, ["pid", "owner", "rank"], "left")
    key = F.substring("digest", 1, key_bytes).alias("key")
    seen = materialise(seen.select("pid", "row", "doc_id", key, "digest", (F.col("again") | F.col("hit").isNotNull()).alias("suspect")).fillna(False, ["suspect"]))
    suspects = seen.where("suspect")

    # The suspects' texts, grouped by their bytes.
    ids = materialise(suspects.select("doc_id").distinct())
    texts = matching(rows, ids, "doc_id").select("doc_id", normalised(F.col("text")).alias("bytes"))
    by_bytes = texts.groupBy("bytes").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    digest = F.unhex(F.sha2(F.col("bytes").cast("binary"), 256))
    groups = by_bytes.select(F.substring(digest, 1, key_bytes).alias("key"), digest.alias("its"), "keep_id", "group_size")
    groups = materialise(groups.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")))
    one = groups.where("texts = 1").drop("texts")
    last = suspects.groupBy("key").agg(F.max(F.struct("doc_id", "pid", "row")).alias("last"))
    one = materialise(one.join(last, "key"))  # written out, so that the join below can split a hot group
    columns = ["doc_id", "keep_id", "group_size", "kept", "digest"]
    kept = (F.col("last.pid") == F.col("pid")) & (F.col("last.row") == F.col("row"))
    out = suspects.join(one, "key").withColumn("kept", kept).select(columns)
    alone = seen.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    out = out.unionByName(alone)

    clashes = materialise(groups.where("texts > 1").select("key"))
    if clashes.limit(1).count():
        # Texts that differ share a key: their rows carry the bytes.
        whole = rows.select("doc_id", normalised(F.col("text")).alias("bytes")).withColumn("digest", digest).withColumn("key", F.substring("digest", 1, key_bytes))
        whole = materialise(matching(whole, clashes, "key").withColumn("row", F.monotonically_increasing_id()))
        best = materialise(whole.groupBy("bytes").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size")))
        apart = whole.join(best, "bytes").select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("last.row") == F.col("row")).alias("kept"), "digest", "key")
        # Rows of such a key that were no suspects stand alone already.
        apart = apart.join(seen.where("not suspect").select(F.col("doc_id").alias("lone"), F.col("digest").alias("its")).join(clashes, F.substring("its", 1, key_bytes) == F.col("key"), "left_semi"), F.col("doc_id").eqNullSafe(F.col("lone")) & (F.col("digest") == F.col("its")), "left_anti")
        out = out.unionByName(apart.select(columns))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs, all its columns, without the rows that exact_groups does not keep."""
    decided = exact_groups(docs).where("group_size > 1").select("doc_id", F.unhex("text_sha256").alias("key"), "kept")
    return keep_rows(docs, decided, lambda text: F.unhex(F.sha2(normalised(text).cast("binary"), 256)))
