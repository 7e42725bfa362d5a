"""State kept between runs: versioned tables, and a binary interchange format."""

from __future__ import annotations

import struct
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ARMS, SKETCH_COLUMNS, SKETCH_SEEDS
from .bandit import PAIRS

MAGIC = b"KSTR"
VERSION = 1


def save_state(state: DataFrame, path: str, version: int) -> None:
    """Writes one version; a reader sees it when it is complete (Spark's commit marker)."""
    state.write.mode("overwrite").parquet(f"{path}/version={version:010d}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first; also in stores that only Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        return []
    found = [(s.getPath().getName(), s.getPath()) for s in store.listStatus(at)]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n.removeprefix("version=")) for n, p in found if n.startswith("version=") and store.exists(done(p, "_SUCCESS")))


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest complete version, or an empty table when there is none."""
    found = versions(spark, path)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version={found[-1]:010d}")


def encode_checkpoint(cells: list[tuple[int, int, int]], arms: dict[int, dict[str, float]], moment: float | None = None, magic: bytes = MAGIC) -> bytes:
    """Sketch cells and arms of one sidecar as one blob: header, counters, matrices as float32, priors as float64.

    At most 2048 cells and 256 arms, so this runs on the driver.
    """
    counters = np.zeros((len(SKETCH_SEEDS), SKETCH_COLUMNS), "<u4")
    for row, col, n in cells:
        counters[row, col] = n & 0xFFFFFFFF
    out = [magic, struct.pack("<Id", VERSION, time.time() if moment is None else moment), struct.pack("<I", counters.nbytes), counters.tobytes(), struct.pack("<II", ARMS, 4)]
    for i in range(ARMS):
        arm = arms.get(i, {})
        a = np.eye(4)
        for r, c in PAIRS:
            a[r, c] = a[c, r] = arm.get(f"a{r}{c}", float(r == c))
        b = np.array([arm.get(f"b{j}", 0.0) for j in range(4)])
        out.append(struct.pack("<I", int(arm.get("n", 0))) + a.astype("<f4").tobytes() + np.linalg.inv(a).astype("<f4").tobytes() + b.astype("<f4").tobytes())
    out.append(struct.pack("<I", ARMS))
    for name in ("alpha", "beta"):
        out.append(np.array([arms.get(i, {}).get(name, 1.0) for i in range(ARMS)], "<f8").tobytes())
    return b"".join(out)


def decode_checkpoint(blob: bytes, magic: bytes = MAGIC) -> tuple[list[tuple[int, int, int]], dict[int, dict[str, float]], float] | None:
    """Cells, arms and time; None for anything that is not a whole checkpoint of this shape."""
    try:
        version, moment = struct.unpack_from("<Id", blob, 4)
        (size,) = struct.unpack_from("<I", blob, 16)
        if blob[:4] != magic or version != VERSION or size != 4 * len(SKETCH_SEEDS) * SKETCH_COLUMNS:
            return None
        counters = np.frombuffer(blob, "<u4", size // 4, 20).reshape(len(SKETCH_SEEDS), SKETCH_COLUMNS)
        at = 20 + size
        if struct.unpack_from("<II", blob, at) != (ARMS, 4):
            return None
        at += 8
        arms: dict[int, dict[str, float]] = {}
        for i in range(ARMS):
            (n,) = struct.unpack_from("<I", blob, at)
            a = np.frombuffer(blob, "<f4", 16, at + 4).reshape(4, 4)
            b = np.frombuffer(blob, "<f4", 4, at + 132)
            arms[i] = {"n": n} | {f"a{r}{c}": float(a[r, c]) for r, c in PAIRS} | {f"b{j}": float(b[j]) for j in range(4)}
            at += 148
        if struct.unpack_from("<I", blob, at) != (ARMS,):
            return None
        priors = np.frombuffer(blob, "<f8", 2 * ARMS, at + 4)
        for i in range(ARMS):
            arms[i] |= {"alpha": float(priors[i]), "beta": float(priors[ARMS + i])}
    except (struct.error, ValueError):
        return None
    cells = [(int(r), int(c), int(counters[r, c])) for r, c in zip(*np.nonzero(counters), strict=True)]
    return cells, {i: a for i, a in arms.items() if a["n"] or a["alpha"] != 1 or a["beta"] != 1}, moment


def checkpoint_stats(spark: SparkSession, path: str) -> DataFrame:
    """saves, failed (versions begun and never finished), newest, its bytes, when it was finished and its age in seconds.

    The moment is that of the newest version's commit marker, whatever its number.
    """
    done = versions(spark, path)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    begun = sum(s.getPath().getName().startswith("version=") for s in store.listStatus(jvm.Path(path))) if store.exists(jvm.Path(path)) else 0
    row: tuple = (len(done), begun - len(done), None, None, None)
    if done:
        folder = f"{path}/version={done[-1]:010d}"
        size = int(store.getContentSummary(jvm.Path(folder)).getLength())
        row = (len(done), begun - len(done), done[-1], size, int(store.getFileStatus(jvm.Path(folder, "_SUCCESS")).getModificationTime()))
    rows = spark.createDataFrame([row], "saves int, failed int, newest long, bytes long, ms long")
    saved = F.timestamp_millis("ms")
    return rows.select("saves", "failed", "newest", "bytes", saved.alias("saved_at"), (F.unix_millis(F.current_timestamp()) - F.col("ms")).alias("age_ms")).withColumn("age_seconds", F.greatest(F.col("age_ms") / 1000, F.lit(0.0))).drop("age_ms")
