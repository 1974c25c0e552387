"""Shared pieces: table reading, durable intermediate results and byte-level Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; a longer document is a step of its own.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch, so that a batch of long documents stays small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lowers (never raises) the session's Arrow batch size to BATCH_ROWS."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_OWN: dict[str, str] = {}
#: Folders that fresh_path has named in this process, so that a caller can discard what a finished step has left.
MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one on a local master and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts the lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of fresh_path whose readers are done."""
    for path in paths:
        held = spark._jvm.org.apache.hadoop.fs.Path(path)
        held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)
        if path in MADE:
            MADE.remove(path)


def free_name(df: DataFrame, base: str) -> str:
    """base, with as many underscores as it takes to be no column of df (case aside)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


#: A key with more than one in HOT_KEYS of all rows is hot: there are fewer than HOT_KEYS of them in any table.
HOT_KEYS = 2000
#: Row numbers or keys that are broadcast at most; beyond that the join shuffles.
BROADCAST_ROWS = 1 << 20


def by_key(rows: DataFrame, unique: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with unique (a stored table of one row per key, n being the rows of that key) of total rows in all.

    Hot keys, fewer than HOT_KEYS by their definition, are joined by broadcast, so that no key's rows meet in one task.
    """
    hot = unique.where(F.col("n") > total / HOT_KEYS)
    cold = unique.where(F.col("n") <= total / HOT_KEYS).drop("n")
    some = rows.join(F.broadcast(hot.drop("n")), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return some.unionByName(rest)


def matched(rows: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """A semi or anti join with keys, a stored table of one column: by broadcast if they are few enough, else by a shuffle."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


def crc_mod(column: str, modulus: int):
    """crc32 of an integer column written as text, modulo modulus."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def utf8(array: pa.Array) -> pa.Array:
    """A binary array without nulls (null becomes empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.cast(pa.binary()).fill_null(b"")


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary array without nulls, and where each value starts in them (one more entry than values)."""
    offsets = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4).astype(np.int64)
    data = array.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    whole = np.frombuffer(data, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that column holds at most limit bytes in each, a single longer row apart."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = raw(utf8(batch.column(batch.schema.get_field_index(column))))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def word_table(extra: bytes = b"") -> np.ndarray:
    """For each byte, the lower-case byte where it belongs to a word (a-z, 0-9, non-ASCII and extra), else 0."""
    to = np.zeros(256, np.uint8)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100), *extra]:
        to[b] = b
    to[0x41:0x5B] = np.arange(0x61, 0x7B)
    return to


def word_spans(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of mask; a run ends where a document (at) ends."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    cuts = at[(at > 0) & (at < n)]
    before[cuts] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[cuts - 1] = False
    return starts, np.flatnonzero(mask & ~after) + 1


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        made = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
        if n > SLICE_BYTES + 1:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of data: a polynomial over its bytes, spread with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    poly = (total[ends] - total[starts]) * down[starts]
    return mixed(poly + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
