"""Substring dedup over words by super-k-mers.

A window is ``k`` consecutive words; its minimiser is the least hash of the word
``m``-grams in it.  Consecutive windows that share a minimiser travel as one packed
string to the minimiser's bucket, where sorting the windows finds for each the smallest
document that has it.  The documents are dealt to blocks first: within a block equal
strings travel once, so no string comes to a bucket more often than there are blocks,
however many documents share it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocked, ranges, run_codes, slices, sliding_min, span_codes, text_chunks, window_codes, word_bounds

_NONE = np.iinfo(np.int64).max
_MOST = 64  # windows in one string; longer runs are cut


def runs(key: np.ndarray, valid: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of valid places with one key."""
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | new[1:]
    length = np.flatnonzero(stop) + 1 - first
    parts = -(-length // most)
    if parts.size and parts.max() > 1:
        step = ranges(np.zeros(len(parts), np.int64), parts) * most
        first = np.repeat(first, parts) + step
        length = np.minimum(np.repeat(length, parts) - step, most)
    return first, length


@dataclass
class Part:
    """A run of documents: their bytes and words."""

    row: int
    stop: int
    data: np.ndarray
    to: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word0: int


class Block:
    """All windows of a block of documents as strings, equal ones once."""

    def __init__(self, table, k: int, m: int):
        import pyarrow as pa
        import pyarrow.compute as pc

        ids = table.column("id").combine_chunks()
        self.known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        self.ids = pc.fill_null(ids, pa.scalar(0, pa.int64())).to_numpy(zero_copy_only=False).astype(np.int64)
        self.parts: list[Part] = []
        first, count, k1, k2, low, doc = [], [], [], [], [], []
        words = 0
        for row, stop, data, to in text_chunks(table, 1 << 20):
            s, e = word_bounds(data)
            self.parts.append(Part(row, stop, data, to, s, e, words))
            of = np.searchsorted(to, s, "right") - 1 + row
            one, two = span_codes(data, s, e)
            n = len(s) - k + 1
            if n > 0:
                least = sliding_min(window_codes(one, m, 0), k - m + 1)
                f, c = runs(least, (of[:n] == of[k - 1 :]) & self.known[of[:n]], _MOST)
                first.append(f + words)
                count.append(c)
                k1.append(run_codes(one, f, c + k - 1, 0))
                k2.append(run_codes(two, f, c + k - 1, 1))
                low.append(least[f])
                doc.append(of[f])
            words += len(s)
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        self.words = words
        self.first, self.count = join(first, np.int64), join(count, np.int64)
        key1, key2, low, self.doc = join(k1, np.uint64), join(k2, np.uint64), join(low, np.uint64), join(doc, np.int64)
        # equal strings have equal keys; the order of the keys numbers them
        order = np.lexsort((key2, key1))
        new = np.ones(len(order), bool)
        new[1:] = (key1[order][1:] != key1[order][:-1]) | (key2[order][1:] != key2[order][:-1])
        head = np.flatnonzero(new)
        self.string = np.empty(len(order), np.int64)
        self.string[order] = np.cumsum(new) - 1
        self.rep = order[head]
        owner = self.ids[self.doc[order]]
        self.low_doc = np.minimum.reduceat(owner, head) if len(head) else owner
        self.high_doc = np.maximum.reduceat(owner, head) if len(head) else owner
        self.minimiser = low[self.rep]
        self.windows = self.count[self.rep]

    def packed(self, which: np.ndarray, k: int) -> list[bytes]:
        """The strings: words joined by one blank."""
        out: list[bytes] = [b""] * len(which)
        at = self.rep[which]
        f, n = self.first[at], self.count[at] + k - 1
        part = np.searchsorted([p.word0 for p in self.parts], f, "right") - 1
        for p in np.unique(part):
            x = self.parts[p]
            keep, s, e = joined(x.data, x.start, x.end)
            raw = keep.tobytes()
            for i in np.flatnonzero(part == p):
                a = f[i] - x.word0
                out[i] = raw[s[a] : e[a + n[i] - 1]]
        return out


def joined(data: np.ndarray, s: np.ndarray, e: np.ndarray, keep: np.ndarray | None = None):
    """Bytes of the kept words with one blank after each, and where each word is in it."""
    length = e - s + 1  # the byte after a word is always there: a gap or the final newline
    if keep is not None:
        s, length = s[keep], length[keep]
    out = data[ranges(s, length)]
    stop = np.cumsum(length)
    out[stop - 1] = 32
    return out, stop - length, stop - 1


def _zip(*arrays) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.int64(a.nbytes).tobytes() + a.tobytes() for a in arrays))


def _unzip(raw: bytes, *types) -> list[np.ndarray]:
    import zstandard

    data, out, at = zstandard.ZstdDecompressor().decompress(raw), [], 0
    for t in types:
        n = int(np.frombuffer(data, np.int64, 1, at)[0])
        out.append(np.frombuffer(data, t, n // np.dtype(t).itemsize, at + 8))
        at += 8 + n
    return out


def tied(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places that are equal in all keys to another place: (place, group), groups
    together.  Only what is tied by one key is sorted by the next."""
    place = np.argsort(keys[0], kind="stable")
    group = np.zeros(len(place), np.int64)
    for i, key in enumerate(keys):
        if i:
            order = np.lexsort((key[place], group))
            place, group = place[order], group[order]
        v = key[place]
        new = np.ones(len(place), bool)
        new[1:] = (v[1:] != v[:-1]) | (group[1:] != group[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(place)))
        keep = np.repeat(size > 1, size)
        group = (np.cumsum(new) - 1)[keep]
        place = place[keep]
    return place, group


def repeated_words(docs: DataFrame, k: int = 13, m: int = 3, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, keep_text: bool = False) -> DataFrame:
    """Remove each word in a window of ``k`` words that starts in a document of smaller id too.

    Per row of ``docs``: id, n_words, n_removed, kept_sha256 and, if asked for, the kept
    words joined by one blank.  Words are runs of anything but ASCII white space.

    * Null or empty text has no words; a text of fewer than k words loses none.
    * Rows that share an id don't take words from each other.  Repeated rows stay.
    * A null id can't be ordered: its row loses nothing and takes nothing.
    * Windows are compared by two independent 64-bit hashes of their words, made from
      the bytes up; the strings that travel are the words themselves.
    * A document, of any length, is read whole by one task; an empty table gives an empty
      one.  Columns other than id and text are left out, whatever their names.
    """
    base, blocks = blocked(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, block_bytes)
    buckets = 4 * blocks

    def send(table):
        import pyarrow as pa

        block = table.column("block")[0].as_py()
        b = Block(table, k, m)
        bucket = (b.minimiser % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        strings = b.packed(order, k)
        edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(order) else np.empty(0, np.int64)
        stop = np.append(edge[1:], len(order))[: len(edge)]  # a block may have no window
        payload = []
        for a, z in zip(edge.tolist(), stop.tolist(), strict=True):
            w = order[a:z]
            payload.append(
                _zip(w.astype(np.uint32), b.windows[w].astype(np.uint8), b.low_doc[w], b.high_doc[w] - b.low_doc[w], np.frombuffer(b"\n".join(strings[a:z]) + b"\n", np.uint8))
            )
        return pa.table({"bucket": pa.array(bucket[order][edge], pa.int64()), "block": pa.array([block] * len(edge), pa.int32()), "payload": pa.array(payload, pa.binary())})

    def resolve(table):
        import pyarrow as pa

        blocks = table.column("block").to_numpy()
        got = [_unzip(x.as_py(), np.uint32, np.uint8, np.int64, np.int64, np.uint8) for x in table.column("payload")]
        string, n, low, high, text = (np.concatenate([g[i] for g in got]) for i in range(5))
        n, high = n.astype(np.int64), low + high
        source = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
        end = np.flatnonzero(text == 10) + 1  # one line a string
        owner = np.repeat(np.arange(len(n)), n)
        parts = []
        for a, z in slices(np.diff(end, prepend=0), 1 << 20):  # bounds what hashing needs beside the keys
            part = text[end[a - 1] if a else 0 : end[z - 1]]
            codes = span_codes(part, *word_bounds(part))
            words = n[a:z] + k - 1
            w = ranges(np.cumsum(words) - words, n[a:z])  # first word of each window
            parts.append([window_codes(c, k, i)[w] for i, c in enumerate(codes)])
        keys = [np.concatenate(x) for x in zip(*parts, strict=True)]
        place, group = tied(keys)
        least = low[owner]
        if len(place):
            start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            best = np.minimum.reduceat(low[owner[place]], start)
            least[place] = np.repeat(best, np.diff(np.append(start, len(place))))
        hit = np.flatnonzero(least < high[owner])
        inside = (hit - (np.cumsum(n) - n)[owner[hit]]).astype(np.uint8)
        to, payload = [], []
        src = source[owner[hit]]
        for i in np.unique(src):
            x = src == i
            to.append(int(blocks[i]))
            payload.append(_zip(string[owner[hit[x]]], inside[x], least[hit[x]]))
        return pa.table({"block": pa.array(to, pa.int32()), "payload": pa.array(payload, pa.binary())})

    def finish(docs_table, answers):
        import pyarrow as pa

        b = Block(docs_table, k, m)
        base_of = np.cumsum(b.windows) - b.windows
        least = np.full(int(b.windows.sum()), _NONE, np.int64)
        for x in answers.column("payload"):
            string, inside, v = _unzip(x.as_py(), np.uint32, np.uint8, np.int64)
            least[base_of[string] + inside] = v
        w = ranges(base_of[b.string], b.count)
        lost = least[w] < np.repeat(b.ids[b.doc], b.count)
        start = ranges(b.first, b.count)[lost]
        d = np.bincount(start, minlength=b.words + 1) - np.bincount(np.minimum(start + k, b.words), minlength=b.words + 1)
        gone = np.cumsum(d[: b.words]) > 0
        n_words, n_gone, sha, kept = [], [], [], []
        for p in b.parts:
            cut = gone[p.word0 : p.word0 + len(p.start)]
            edge = np.searchsorted(p.start, p.to)  # first word of each document
            c = np.concatenate([[0], np.cumsum(cut)])
            n_words.append(np.diff(edge))
            n_gone.append(np.diff(c[edge]))
            out, s, e = joined(p.data, p.start, p.end, ~cut)
            raw = out.tobytes()
            word = edge - c[edge]
            at = np.append(s, len(out))[word]
            for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                x = raw[a : max(a, z - 1)]
                sha.append(hashlib.sha256(x).hexdigest())
                if keep_text:
                    kept.append(x.decode())
        cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0), pa.int64())
        out = {"doc_id": docs_table.column("id"), "n_words": cat(n_words), "n_removed": cat(n_gone), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.string())} if keep_text else {}))

    sent = base.groupBy("block").applyInArrow(send, "bucket long, block int, payload binary")
    answers = sent.groupBy("bucket").applyInArrow(resolve, "block int, payload binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_words(docs)


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
lost AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS f FROM win) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM lost),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS kept, count(*) AS n
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i WHERE gone.i IS NULL GROUP BY word.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
