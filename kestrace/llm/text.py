"""Byte-level text helpers shared by the operators of this package.

Texts are handled as UTF-8 bytes in blocks of bounded size, so that one numpy call
covers thousands of words and memory follows the block (or the longest single text),
never the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
SEP = 0x20

#: [\x20\x09-\x0D], the white space of every contract here.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, the same in every process."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = seeds(256, 11)
P = 0x9E3779B97F4A7C15 | 1
P_INV = pow(P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, BLOCK_BYTES + 4096), base, np.uint64)
        x[0] = 1
        have = _powers[base] = np.cumprod(x, dtype=np.uint64)
    return have[:n]


class Block:
    """Some rows' texts as one byte array, each text followed by a separator.

    data: bytes; start, end: each text's range in data.
    """

    def __init__(self, texts: list[bytes], sep: int = SEP):
        joined = bytes([sep]).join(texts) + bytes([sep])
        self.data = np.frombuffer(joined, np.uint8)
        size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.n = len(texts)

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and for each text its first word (n + 1 entries)."""
        space = IS_SPACE[self.data if data is None else data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        return start, end, np.searchsorted(start, np.append(self.start, len(space)))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power(P, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end], the same wherever the bytes stand."""
    return mix64((prefix[end] - prefix[start]) * power(P_INV, len(prefix))[start])


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words inside each text, and each text's first run (n + 1).

    A text of 1 to k - 1 words has one run, all its words; an empty text has none.
    """
    count = np.diff(first)
    runs = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    base = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(base[-1]) - np.repeat(base[:-1], runs) + np.repeat(first[:-1], runs)
    left = np.repeat(np.minimum(count, k), runs)
    out = np.zeros(base[-1], np.uint64)
    mul, add = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
    padded = np.append(words, np.zeros(k, np.uint64))
    for i in range(k):
        out = out * mul + np.where(left > i, padded[at + i], add)
    return mix64(out), base


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows whose texts have at most limit bytes in all, or one longer text: (first row, texts)."""
    col = pc.fill_null(batch.column(column), "")
    col = col.cast(pa.large_binary()) if not pa.types.is_binary(col.type) else col
    held, size, first = [], 0, 0
    for i in range(len(col)):
        t = col[i].as_buffer().to_pybytes()
        if held and size + len(t) > limit:
            yield first, held
            held, size, first = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name += "_"
    return name


#: Bytes of an Arrow batch between Spark and Python, about.
ARROW_BYTES = 4 << 20


def bounded_batches(docs: DataFrame) -> DataFrame:
    """docs, whose session from now on sends Python at most ARROW_BYTES at a time (or one row); a lower setting stays.

    The default is 10 000 rows or 64 MB, of which each task holds several.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (conf.get(key, None) or "").rstrip("b")
    if not now.isdigit() or int(now) > ARROW_BYTES:
        conf.set(key, str(ARROW_BYTES))
    return docs


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; any further columns, whatever their names, stay behind."""
    docs = bounded_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def per_document(docs: DataFrame, schema: str, score: Callable[[list[bytes]], dict]) -> DataFrame:
    """One output row for each input row: doc_id and what score gives for blocks of texts.

    score takes a list of texts and returns equally long columns by name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in blocks(batch):
                got = score(texts)
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(first, len(texts)), **got})

    return id_text(docs).mapInArrow(run, f"doc_id long, {schema}")
