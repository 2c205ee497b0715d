"""Shared plumbing: shared folders, block sizing, distributed numbering and
vectorised hashing over packed bytes."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import inspect
import shutil
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, the only separators that the word operators know.
SPACES = b" \t\n\x0b\x0c\r"


# --- cluster plumbing -------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none (tests, local mode) a temporary folder is
    made; a cluster must set it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        at = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the
    lineage, survives lost executors and gives later plans exact sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(df: DataFrame, text: str, target_bytes: int) -> int:
    """Blocks of about ``target_bytes`` of text, from the exact total size."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(shuffle_partitions(df.sparkSession), -(-total // target_bytes))


def blocked(docs: DataFrame, id_col: str, text_col: str, target_bytes: int = 8 << 20) -> tuple[DataFrame, int]:
    """``(block, id, text)`` with documents dealt evenly to blocks by a hash of id and
    length, and the number of blocks."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = block_count(src, "text", target_bytes)
    block = F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(n)).cast("int")
    return src.select(block.alias("block"), "id", "text"), n


def numbered(df: DataFrame, group: str, bucket: str, order: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 within ``group``, ordered by ``bucket`` then ``order``.

    Rows are only sorted within (group, bucket); a small table of counts gives each
    bucket its offset.  So a group that holds a third of all rows is still spread.
    """
    local = Window.partitionBy(group, bucket).orderBy(*order)
    counts = df.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("__g"), F.col(bucket).alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o")
    )
    ranked = df.withColumn("__r", F.row_number().over(local).cast("long") - 1)
    joined = ranked.join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col(bucket) == F.col("__b")))
    return joined.withColumn(name, F.col("__r") + F.col("__o")).drop("__g", "__b", "__o", "__r")


# --- memory of Python workers -----------------------------------------------

_GIVEN = [0.0]


def give_back(every: float = 0.25) -> None:
    """Hand what this process has freed back to the system, not more often than ``every`` seconds.

    Spark keeps idle workers for a minute and takes any of them for the next task, so what
    each holds adds up on an executor.
    """
    import pyarrow as pa

    if time.monotonic() - _GIVEN[0] < every:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # no glibc
        pass
    _GIVEN[0] = time.monotonic()


def few_at_once(batches, target: int = 2 << 20):
    """The same rows in runs of about ``target`` bytes, one row at least; empty batches are left out."""
    for batch in batches:
        step = max(1, batch.num_rows * target // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def lean(work):
    """``work`` on one or two Arrow tables, or on batches that it turns into others; when it is
    done and its arrays are gone, their memory is given back."""
    if inspect.isgeneratorfunction(work):

        def run(batches):
            yield from work(batches)
            give_back(0)

        return run

    def one(table):
        out = work(table)
        give_back()
        return out

    def two(left, right):
        out = work(left, right)
        give_back()
        return out

    return one if len(inspect.signature(work).parameters) == 1 else two


# --- native expressions -----------------------------------------------------


def ascii_lower(col):
    """Lower-case A-Z only.  ``lower`` is the fast way where a text is all ASCII."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, upper, low))


# --- vectorised hashing -----------------------------------------------------

class Roller:
    """Polynomial hashes modulo 2**64 of all windows of an array of bytes.

    They choose places (anchors) and nothing else: there are texts whose different
    windows meet in such a hash, so what must be equal is compared by ``span_codes``
    or by its bytes.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.seed = seed
        self.table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 1 << 62)) * 4 + 5 & (1 << 64) - 1 | 1
        self.inverse = pow(self.base, -1, 1 << 64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = self._powers.get(self.seed)
        if have is None or len(have[0]) < n:
            size = max(n, 1 << 16)
            made = []
            for b in (self.base, self.inverse):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
            have = made[0], made[1]
            if size <= 1 << 22:
                self._powers[self.seed] = have
        return have

    def windows(self, data: np.ndarray, k: int) -> np.ndarray:
        """The hash of every window of ``k`` bytes."""
        n = len(data) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        forth, back = self.powers(len(data) + 1)
        pre = self.table[data]
        pre *= forth[: len(data)]
        np.cumsum(pre, out=pre)
        out = pre[k - 1 :].copy()
        out[1:] -= pre[: n - 1]
        out *= back[:n]
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: the order of its values is as good as random."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_SPREAD = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F))
_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
_TAIL = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
_LONG = 512  # bytes; longer spans are left to blake2b


def _step(h: np.ndarray, x: np.ndarray, which: int) -> np.ndarray:
    """Take one more word into a hash: bijective in each argument and not linear."""
    h = h ^ x
    h *= _SPREAD[which]
    h ^= h >> np.uint64(29 + which * 3)
    return h


def lanes(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes at every place of ``data`` (zeros behind its end) as a number."""
    padded = np.concatenate([data.view(np.uint8), np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), f"{order}u8", padded.data, strides=(1,))


def span_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray, many: int = 2) -> list[np.ndarray]:
    """``many`` (1 or 2) independent 64-bit hashes of each span of bytes, from the bytes up.

    Eight bytes are taken in at a time by a step that isn't linear, so patterns in a
    text can't make them meet; spans of over 512 bytes are hashed by blake2b.
    """
    n = end - start
    out = [mixed(n.astype(np.uint64) ^ _SEEDS[i]) for i in range(many)]
    word = lanes(data)
    live = np.flatnonzero((n > 0) & (n <= _LONG))
    at, rest = start[live], n[live]
    while len(live):
        x = word[at] & _TAIL[np.minimum(rest, 8)]
        for i, h in enumerate(out):
            h[live] = _step(h[live], x, i)
        keep = rest > 8
        live, at, rest = live[keep], at[keep] + 8, rest[keep] - 8
    for i in np.flatnonzero(n > _LONG).tolist():
        two = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]], digest_size=16).digest(), np.uint64)
        for k, h in enumerate(out):
            h[i] = two[k]
    return [mixed(h) for h in out]


def window_codes(code: np.ndarray, k: int, which: int) -> np.ndarray:
    """The hash of every ``k`` consecutive codes."""
    n = len(code) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, _SEEDS[which] + np.uint64(k), np.uint64)
    for j in range(k):
        h = _step(h, code[j : n + j], which)
    return mixed(h)


def run_codes(code: np.ndarray, first: np.ndarray, size: np.ndarray, which: int) -> np.ndarray:
    """The hash of the ``size[i]`` codes from ``first[i]`` on, taken in by fours."""
    h = mixed(size.astype(np.uint64) ^ _SEEDS[which])
    few = np.flatnonzero((size > 0) & (size < 4))
    for j in range(3):
        few = few[size[few] > j]
        h[few] = _step(h[few], code[first[few] + j], which)
    four = window_codes(code, 4, which)
    live = np.flatnonzero(size >= 4)
    h[live] = _step(h[live], four[(first + size - 4)[live]], which)
    j = 0
    while True:
        live = live[size[live] > j + 4]
        if not len(live):
            return mixed(h)
        h[live] = _step(h[live], four[first[live] + j], which)
        j += 4


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every ``w`` consecutive values, by doubling."""
    if len(x) < w:
        return x[:0]
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(out) - (w - have)], out[w - have :])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``start, start+1, ...`` runs."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def slices(sizes: np.ndarray, target: int):
    """Runs (first, end) of items with about ``target`` in all, at least one each."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + target, "right"))
        b = min(max(b, a + 1), len(sizes))
        yield a, b
        a = b


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that aren't ASCII white space."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _SPACE[data]
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    return turn[::2], turn[1::2]


def text_chunks(table, target: int = 2 << 20):
    """Cut an Arrow table (id, text) into runs of rows with about ``target`` bytes:
    yields (first row, ids, bytes of all texts each followed by a newline, offsets)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    text = table.column("text").combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    text = pc.fill_null(text, "")
    n = len(text)
    sizes = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    row = 0
    while row < n:
        base = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, base + target, "right")))
        stop = min(stop, n)
        part = text.slice(row, stop - row)
        off = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, part.offset * 8)
        raw = np.frombuffer(part.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        lens = off[1:] - off[:-1]
        to = np.concatenate([[0], np.cumsum(lens + 1)])
        data = np.full(int(to[-1]), 10, np.uint8)
        if len(raw):
            keep = np.ones(int(to[-1]), bool)
            keep[to[1:] - 1] = False
            data[keep] = raw
        yield row, stop, data, to
        row = stop
