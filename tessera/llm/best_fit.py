"""Best-fit packing of token sequences.

Documents are tokenised in one pass.  How they are packed depends only on how many
pieces there are of each length, so the plan is made on the driver from at most 1,024
counts: lengths that exactly fill a gap, alone, as a pair or as a triple, are used up
as often as their counts allow; what is left goes best fit.  The plan is a bounded
list of intervals of ranks within a length, and pieces find their place by rank.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, numbered, ranges, span_codes, stored

# --- tokenising ------------------------------------------------------------------

_LIMIT = 0x2070  # code points above it take the library's own splitter


class Encoder:
    """Byte-level BPE from a ``tokenizers`` file: vectorised pre-tokens, each distinct
    one encoded once and known by its string.  Texts with apostrophes (contractions) or
    rare code points are left to the library, and texts with an added token to
    ``tokenizers``, which gives it its id."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, keep: int = 400_000):
        import tiktoken
        import unicodedata

        model = json.load(open(path, encoding="utf-8"))
        special = {x["content"] for x in model["added_tokens"]}
        self.added, self.path, self.library = sorted(special), path, None
        # the public byte alphabet of byte-level BPE: printable bytes stand for themselves
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.bpe = tiktoken.Encoding("tessera", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        kinds = np.full(_LIMIT, 3, np.uint8)
        for c in range(_LIMIT):
            cat = unicodedata.category(chr(c))
            kinds[c] = 0 if chr(c).isspace() and c not in range(0x1C, 0x20) else 1 if cat[0] == "L" else 2 if cat[0] == "N" else 3
        self.kinds, self.keep = kinds, keep
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.at = np.zeros(1 << 16, np.int64)

    def _learn(self, strings: list[str]):
        for string in strings:
            ids, n = self.bpe.encode_ordinary(string), len(self.known)
            self.known[string] = n
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), len(ids)), np.uint32)])
            if n + 2 > len(self.at):
                self.at = np.concatenate([self.at, np.zeros(len(self.at), np.int64)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.at[n + 1] = self.used

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another (uint32) and the number for each text."""
        added = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        plain = [i for i, t in enumerate(texts) if i not in added and "'" not in t and (t.isascii() or max(t) < chr(_LIMIT))]
        ids, counts = self._plain([texts[i] for i in plain])
        if len(plain) == len(texts):
            return ids, counts
        parts = dict(zip(plain, np.split(ids, np.cumsum(counts)[:-1]), strict=True)) if plain else {}

        def rest(i: int, t: str) -> list[int]:
            return self._whole(t) if i in added else self.bpe.encode_ordinary(t)

        out = [parts[i] if i in parts else np.array(rest(i, t), np.uint32) for i, t in enumerate(texts)]
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _whole(self, text: str) -> list[int]:
        if self.library is None:  # few texts need it, and it takes memory
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library.encode(text, add_special_tokens=False).ids

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        whole = "".join(texts)
        if not whole:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = self.kinds[cp]
        first = np.zeros(len(cp) + 1, bool)  # text starts
        ends = np.cumsum(sizes)
        first[ends - sizes] = True
        first = first[:-1]
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        gap = kind == 0
        last = gap[:-1] & ~gap[1:] & ~first[1:]  # the last space before something else
        start[:-1] |= last
        start[1:][last & (cp[:-1] == 32)] = False  # a blank goes with what follows
        s = np.flatnonzero(start)
        e = np.append(s[1:], len(cp))
        one, two = span_codes(cp.astype("<u2").view(np.uint8), 2 * s, 2 * e)  # all are below _LIMIT
        _, place, inv = np.unique(one, return_index=True, return_inverse=True)
        if (two[place][inv] != two).any():  # one hash for two strings: both tell them apart
            _, place, inv = np.unique(np.stack([one, two], 1), axis=0, return_index=True, return_inverse=True)
        strings = [whole[a:b] for a, b in zip(s[place].tolist(), e[place].tolist(), strict=True)]
        if len(self.known) + len(strings) > self.keep:
            self._clear()
        self._learn([x for x in strings if x not in self.known])
        token = np.fromiter((self.known[x] for x in strings), np.int64, len(strings))[inv]
        n = self.at[token + 1] - self.at[token]
        ids = self.flat[ranges(self.at[token], n)]
        upto = np.concatenate([[0], np.cumsum(n)])
        edge = np.searchsorted(s, ends - sizes, "left")
        bounds = upto[np.append(edge, len(s))]
        counts = np.diff(bounds)
        return ids, counts


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    Null text is empty; every document ends with ``end_id``, so none has no piece.
    A document of more than ``size`` ids is cut so that all pieces but the first are full.
    A document, of any length, is encoded whole by one task; an empty table gives an empty
    one; repeated rows are documents of their own.  Columns other than id and text are left
    out, whatever their names.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def pieces(batches):
        import pyarrow as pa

        enc = _encoder(tokenizer)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            row = 0
            while row < batch.num_rows:
                part, chars = [], 0
                while row + len(part) < batch.num_rows and (not part or chars < 500_000):
                    part.append(texts[row + len(part)].as_py() or "")
                    chars += len(part[-1])
                ids, counts = enc.encode(part)
                m = counts + 1
                stop = np.cumsum(m)
                every = np.full(int(stop[-1]), end_id, np.uint32)
                mask = np.ones(len(every), bool)
                mask[stop - 1] = False
                every[mask] = ids
                cuts = -(-m // size)
                doc = np.repeat(np.arange(len(part)), cuts)
                piece = ranges(np.zeros(len(part), np.int64), cuts)
                head = m - (cuts - 1) * size
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * size)
                length = np.where(piece == 0, head[doc], size)
                at = (stop - m)[doc] + start
                raw = memoryview(every.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                cols = [names.slice(row, len(part)).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([every[a : a + n].astype(np.int64) for a, n in zip(at, length, strict=True)], pa.list_(pa.int64())))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(cols, fields)
                row += len(part)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(lean(pieces), schema)


# --- packing ---------------------------------------------------------------------


class Complements:
    """Which lengths, pairs and triples of lengths have a sum, under the counts left.

    The index is made once.  Counts only fall, so what has run out goes from it for good.
    """

    def __init__(self, count: np.ndarray):
        self.count = count
        has = count > 0
        self.pairs: list[list[int]] = []  # by sum: the smaller length, the most even pair last
        for gap in range(len(count)):
            a = np.arange(1, gap // 2 + 1)
            self.pairs.append(a[has[a] & has[gap - a]].tolist())
        some = np.array([bool(x) for x in self.pairs])
        self.triples: list[list[int]] = []  # by sum: a length that leaves the sum of a pair
        for gap in range(len(count)):
            c = np.arange(1, gap // 3 + 1)
            self.triples.append(c[has[c] & some[gap - c]].tolist())

    def single(self, left: np.ndarray, gap: int) -> tuple[int, ...]:
        return (gap,) if left[gap] else ()

    def pair(self, left: np.ndarray, gap: int) -> tuple[int, ...]:
        own = self.pairs[gap]
        while own and not (self.count[own[-1]] and self.count[gap - own[-1]]):
            own.pop()
        for a in reversed(own):
            b = gap - a
            if left[a] > (a == b) and left[b]:
                return (b, a)
        return ()

    def triple(self, left: np.ndarray, gap: int) -> tuple[int, ...]:
        own = self.triples[gap]
        while own and not (self.count[own[-1]] and self.pairs[gap - own[-1]]):
            own.pop()
        for c in reversed(own):
            if left[c]:
                left[c] -= 1
                rest = self.pair(left, gap - c)
                left[c] += 1
                if rest:
                    return (*rest, c)
        return ()

    def fill(self, left: np.ndarray, gap: int) -> tuple[int, ...]:
        """Lengths of sum ``gap``, as few as can be, or none."""
        return self.single(left, gap) or self.pair(left, gap) or self.triple(left, gap)


def plan(counts: Mapping[int, int], size: int = 1024) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, how many such sequences) for pieces of 1 to ``size``."""
    count = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        count[n] = c
    index, out = Complements(count), []

    def use(lengths: tuple[int, ...]) -> None:
        kinds, need = np.unique(lengths, return_counts=True)
        m = int((count[kinds] // need).min())
        count[kinds] -= need * m
        out.append((lengths, m))

    for n in range(size, 0, -1):
        while count[n]:
            left, gap, lengths = count.copy(), size - n, [n]
            left[n] -= 1
            while gap:
                exact = index.fill(left, gap)
                if exact:
                    lengths += exact
                    break
                fits = np.flatnonzero(left[1 : gap + 1])
                if not len(fits):
                    break
                best = int(fits[-1]) + 1
                left[best] -= 1
                lengths.append(best)
                gap -= best
            use(tuple(lengths))
    return out


def intervals(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) of a plan."""
    taken: dict[int, int] = {}
    out, base = [], 0
    for lengths, m in patterns:
        offset = 0
        for n in lengths:
            rank = taken.get(n, 0)
            out.append((n, rank, rank + m, base, offset))
            taken[n] = rank + m
            offset += n
        base += m
    return out


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of ``token_pieces``.

    Repeated rows are pieces of their own.  The rank of a piece among those of its
    length follows a hash of its id, then id, piece and checksum.  An empty table gives an
    empty one; other columns stay as they are, whatever their names.
    """
    spark = pieces.sparkSession
    extra = [c for c in pieces.columns if c not in ("doc_id", "piece", "length", "ids_crc32", "sequence_id", "offset")]
    names, pieces = [c for c in pieces.columns if c not in ("sequence_id", "offset")], pieces.select(
        "doc_id", "piece", "length", "ids_crc32", F.struct(*[F.col(f"`{c}`") for c in extra], F.lit(0).alias("__none")).alias("__extra")
    )
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    rows = intervals(plan(counts, size)) or [(0, 0, 0, 0, 0)]
    places = spark.createDataFrame(rows, "__len long, __lo long, __hi long, __seq long, offset long")
    ranked = numbered(
        pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4096))), "length", "__bucket", ["doc_id", "piece", "ids_crc32"], "__rank"
    )
    # the plan is bounded by the number of lengths, not by the data
    hit = ranked.join(
        F.broadcast(places), (F.col("length") == F.col("__len")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi"))
    )
    kept = [F.col("__extra").getField(c).alias(c) if c in extra else F.col(c) for c in names]
    return hit.select(*kept, (F.col("__seq") + F.col("__rank") - F.col("__lo")).alias("sequence_id"), "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_best_fit_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = stored(token_pieces(docs, tokenizer or default_tokenizer()), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
