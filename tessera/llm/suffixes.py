"""Substring dedup over bytes with sorted suffixes.

A window is ``k`` bytes; its anchor is the place of the least hash of the ``gram`` byte
strings in it (the first, if several are least).  Equal windows have equal anchors at
equal places, so only the suffixes at anchors are sorted, one for about 140 bytes.

1. Blocks report the grams at their anchors; only grams that occur again go on.
2. Sampled splitters, each the leading ``gram`` bytes of a suffix, range-partition the
   remaining suffixes.  A suffix carries the bytes of all windows that have it as anchor,
   equal ones of a block once, so a passage that a third of all documents share comes
   once a block.
3. Each range sorts its suffixes by a multikey sort: eight bytes at a time, each word only
   among what the last left tied; and the bytes before the anchors, read backwards, in
   the same way.  Two windows are equal where they are of one group in both orders, by
   the lengths of common prefixes alone: no hash decides.  A range ends only where the
   leading ``gram`` bytes change, so suffixes across a boundary have less in common
   than the anchors of equal windows and no group crosses it.
4. Blocks learn which windows are repeated and cut their documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Roller, blocked, lanes, mixed, ranges, sliding_min, stored, text_chunks
from .superkmers import _unzip, _zip, runs

_GRAMS = Roller(21)
_SAMPLED_SHARDS, _SAMPLE_EACH = 256, 64  # bounds of the sample for splitters
_PLACE = np.uint64(0xFFFFFFFF)
_LEADING = np.array([1 << 64 - 8 * i for i in range(1, 8)], np.uint64)


class Chunk:
    """Runs of windows with one anchor in a run of documents."""

    def __init__(self, row: int, stop: int, data: np.ndarray, to: np.ndarray, k: int, gram: int):
        self.row, self.stop, self.data, self.to = row, stop, data, to
        n = len(data) - k + 1
        if n <= 0:
            self.first = self.count = self.anchor = np.empty(0, np.int64)
            self.value = np.empty(0, np.uint64)
            return
        grams = mixed(_GRAMS.windows(data, gram))
        # half of the hash, then the place: the first of the least ones
        key = grams & ~_PLACE
        key |= np.arange(len(grams), dtype=np.uint64)
        least = sliding_min(key, k - gram + 1)
        del key
        least &= _PLACE
        d = np.zeros(n + 1, np.int32)
        size = np.diff(to) - 1  # without the newline after each document
        fit = size >= k
        np.add.at(d, to[:-1][fit], 1)
        np.add.at(d, (to[:-1] + size - k + 1)[fit], -1)
        self.first, self.count = runs(least, np.cumsum(d[:n]) > 0, k)
        self.anchor = least[self.first].astype(np.int64)
        self.value = grams[self.anchor]


def _chunks(table, k: int, gram: int):
    for row, stop, data, to in text_chunks(table, 1 << 20):
        yield Chunk(row, stop, data, to, k, gram)


class Strings:
    """The strings of a block whose anchor is in ``values``, equal ones once."""

    def __init__(self, table, values: np.ndarray, k: int, gram: int):
        self.parts, self.k = [], k
        first, count, chunk, anchor, digest = [], [], [], [], []
        for c in _chunks(table, k, gram):
            which = np.flatnonzero(np.isin(c.value, values))
            f, n = c.first[which], c.count[which]
            first.append(f)
            count.append(n)
            chunk.append(np.full(len(f), len(self.parts)))
            anchor.append(c.anchor[which])
            raw = memoryview(c.data)
            digest += [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(f.tolist(), (f + n + k - 1).tolist(), strict=True)]
            self.parts.append((c.row, c.stop, c.data, c.to))
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        self.first, self.count, self.chunk, self.anchor = join(first), join(count), join(chunk), join(anchor)
        key1, key2 = np.frombuffer(b"".join(digest), np.uint64).reshape(-1, 2).T
        order = np.lexsort((key2, key1))
        new = np.ones(len(order), bool)
        new[1:] = (key1[order][1:] != key1[order][:-1]) | (key2[order][1:] != key2[order][:-1])
        head = np.flatnonzero(new)
        self.string = np.empty(len(order), np.int64)
        self.string[order] = np.cumsum(new) - 1
        self.copies = np.diff(np.append(head, len(order)))
        self.rep = order[head]
        self.windows = self.count[self.rep]

    def leads(self, gram: int) -> np.ndarray:
        """The gram at the anchor of each string."""
        out = np.empty(len(self.rep), f"S{gram}")
        for p, (_, _, data, _) in enumerate(self.parts):
            x = np.flatnonzero(self.chunk[self.rep] == p)
            out[x] = grams_at(data, self.anchor[self.rep[x]], gram)
        return out

    def raw(self, which: np.ndarray) -> bytes:
        at = self.rep[which]
        return b"".join(self.parts[c][2][a:b].tobytes() for c, a, b in zip(self.chunk[at].tolist(), self.first[at].tolist(), (self.first[at] + self.count[at] + self.k - 1).tolist(), strict=True))


def grams_at(data: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    return data[at[:, None] + np.arange(gram)].reshape(-1).view(f"S{gram}") if len(at) else np.empty(0, f"S{gram}")


def _cut(order: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = key[order]
    edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, np.int64)
    return edge, np.append(edge[1:], len(v))[: len(edge)]  # a block may have none


def _values(table) -> np.ndarray:
    got = [_unzip(x.as_py(), np.uint64)[0] for x in table.column("payload")]
    return np.unique(np.concatenate(got)) if got else np.empty(0, np.uint64)


def multikey_sort(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of ``size[i]`` bytes from ``at[i]`` on, and how many bytes
    each has in common with the one before it.

    Eight bytes at a time: a word is only looked at among what all words before left tied.
    """
    word = lanes(data, ">")
    order = np.argsort(size, kind="stable")  # the shorter of two with equal bytes comes first
    common = np.zeros(len(at), np.int64)
    live = np.arange(len(at))  # places in the order that are tied with a neighbour
    group = np.zeros(len(at), np.int64)
    depth = 0
    while len(live):
        who = order[live]
        left = size[who] - depth
        x = word[np.minimum(at[who] + depth, len(data))].astype(np.uint64)
        short = np.flatnonzero(left < 8)
        x[short] &= ~np.uint64(0) << (np.uint64(8) * (8 - np.clip(left[short], 1, 8)).astype(np.uint64))
        x[short[left[short] <= 0]] = 0
        by = np.lexsort((x, group))  # stable
        who, x, group = who[by], x[by], group[by]
        order[live] = who
        tie = np.zeros(len(live), bool)
        tie[1:] = group[1:] == group[:-1]
        differ = np.zeros(len(live), np.uint64)
        differ[1:] = x[1:] ^ x[:-1]
        new = np.flatnonzero(tie & (differ != 0))
        agree = (differ[new][:, None] < _LEADING).sum(1)  # leading bytes
        common[live[new]] = depth + agree
        tie[new] = False
        ended = np.flatnonzero(tie & (np.minimum(size[who], np.concatenate([[0], size[who[:-1]]])) <= depth + 8))
        common[live[ended]] = size[who[ended - 1]]
        # what has ended, and all that is tied with it, is sorted by size
        start = ~tie
        group = np.cumsum(start) - 1
        n = np.bincount(group)
        going = np.bincount(group, (size[who] > depth + 8).astype(np.float64)) > 1
        keep = (n > 1) & going
        stay = keep[group]
        live, group = live[stay], group[stay]
        depth += 8
    lo = np.minimum(size[order], np.concatenate([[0], size[order[:-1]]])) if len(at) else size
    return order, np.minimum(common, lo)


def repeated_windows(text: np.ndarray, at: np.ndarray, n: np.ndarray, anchor: np.ndarray, k: int) -> np.ndarray:
    """Which windows occur again: string i starts at ``at[i]`` of ``text``, has ``n[i]``
    windows and its anchor ``anchor[i]`` bytes from its start.  Windows in a row."""
    right, r_common = multikey_sort(text, at + anchor, n + k - 1 - anchor)
    flip = np.ascontiguousarray(text[::-1])
    left, l_common = multikey_sort(flip, len(text) - at - anchor, anchor)
    base = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), bool)
    place = np.arange(len(n))
    low = anchor - n + 1
    one, two = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
    for before in range(int(low.min(initial=0)), int(anchor.max(initial=-1)) + 1):
        on = np.flatnonzero((low <= before) & (before <= anchor))
        if len(on) < 2:
            continue
        one[right] = np.maximum.accumulate(np.where(r_common < k - before, place, 0))
        two[left] = np.maximum.accumulate(np.where(l_common < before, place, 0))
        key = one[on] * len(n) + two[on]
        by = np.argsort(key)
        v = key[by]
        same = np.zeros(len(by) + 1, bool)
        same[1:-1] = v[1:] == v[:-1]
        hit = on[by[same[1:] | same[:-1]]]
        out[base[hit] + anchor[hit] - before] = True
    return out


def repeated_bytes(docs: DataFrame, k: int = 400, gram: int = 128, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, keep_bytes: bool = False) -> DataFrame:
    """Remove each byte in a string of ``k`` bytes that starts anywhere else too.

    Per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for,
    the remaining bytes (which may cut a character).  Matches never cross documents;
    overlapping ones and those within one document count; all copies are removed.

    * Null or empty text has no bytes; a text of fewer than ``k`` bytes loses none.
    * Repeated rows are copies of each other; a null id is an id like any other.
    * Windows are compared by their bytes; what a block holds several times is told by 128
      bits of hash of its bytes.
    * A document, of any length, is read whole by one task; an empty table gives an empty
      one.  Columns other than id and text are left out, whatever their names.
    """
    base, blocks = blocked(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, block_bytes)
    shards = 2 * blocks

    def report(table):
        import pyarrow as pa

        value, lead, n = [np.empty(0, np.uint64)], [np.empty(0, f"S{gram}")], [np.empty(0, np.int64)]
        for c in _chunks(table, k, gram):
            v, at, many = np.unique(c.value, return_index=True, return_counts=True)
            value.append(v)
            n.append(many)
            # the sample of leading bytes: those of the least grams of some shards
            some = (v >> np.uint64(20)) % np.uint64(shards) < _SAMPLED_SHARDS
            lead.append(np.where(some & (v % np.uint64(16) == 0), grams_at(c.data, c.anchor[at], gram), b""))
        v, at, inv = np.unique(np.concatenate(value), return_index=True, return_inverse=True)
        many = np.bincount(inv, np.concatenate(n), minlength=len(v)) > 1
        lead = np.concatenate(lead)[at]
        shard = (v >> np.uint64(20)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        edge, stop = _cut(order, shard)
        payload = []
        for a, z in zip(edge, stop, strict=True):
            own = lead[order[a:z]]
            has = np.flatnonzero(own != b"")
            payload.append(_zip(v[order[a:z]], many[order[a:z]], has.astype(np.uint32), own[has].view(np.uint8)))
        block = table.column("block")[0].as_py()
        return pa.table({"shard": pa.array(shard[order][edge].astype(np.int64)), "block": pa.array([block] * len(edge), pa.int32()), "payload": pa.array(payload, pa.binary())})

    def again(table):
        import pyarrow as pa

        got = [_unzip(x.as_py(), np.uint64, np.bool_, np.uint32, np.uint8) for x in table.column("payload")]
        v = np.concatenate([g[0] for g in got])
        uniq, inv, n = np.unique(v, return_inverse=True, return_counts=True)
        more = n > 1
        more[inv[np.concatenate([g[1] for g in got])]] = True
        keep = more[inv]
        to, payload, leads, at = [], [], {}, 0
        for block, g in zip(table.column("block").to_pylist(), got, strict=True):
            x = keep[at : at + len(g[0])]
            at += len(g[0])
            if x.any():
                to.append(block)
                payload.append(_zip(g[0][x]))
                leads |= {int(g[0][i]): y for i, y in zip(g[2].tolist(), g[3].reshape(-1, gram), strict=True) if x[i]}
        few = b"".join(leads[i].tobytes() for i in sorted(leads)[:_SAMPLE_EACH])
        sample = [few if i == 0 and few else None for i in range(len(to))]
        return pa.table({"block": pa.array(to, pa.int32()), "payload": pa.array(payload, pa.binary()), "sample": pa.array(sample, pa.binary())})

    grams = base.groupBy("block").applyInArrow(report, "shard long, block int, payload binary")
    repeats = stored(grams.groupBy("shard").applyInArrow(again, "block int, payload binary, sample binary"), "repeats")
    sample = [r[0] for r in repeats.where("sample is not null").select("sample").collect()]  # 256 x 64 grams at most
    leads = np.unique(np.frombuffer(b"".join(sample), f"S{gram}"))
    splitters = np.unique(leads[np.linspace(0, len(leads) - 1, 2 * blocks + 1).astype(int)[1:-1]]) if len(leads) else leads
    repeats = repeats.select("block", "payload")

    def send(table, known):
        import pyarrow as pa

        s = Strings(table, _values(known), k, gram)
        part = np.searchsorted(splitters, s.leads(gram), "right")
        order = np.argsort(part, kind="stable")
        edge, stop = _cut(order, part)
        payload = []
        for a, z in zip(edge.tolist(), stop.tolist(), strict=True):
            w = order[a:z]
            at = s.rep[w]
            payload.append(_zip(w.astype(np.uint32), s.windows[w].astype(np.uint16), (s.anchor - s.first)[at].astype(np.uint16), s.copies[w] > 1, np.frombuffer(s.raw(w), np.uint8)))
        block = table.column("block")[0].as_py() if table.num_rows else 0
        return pa.table({"range": pa.array(part[order][edge], pa.int64()), "block": pa.array([block] * len(edge), pa.int32()), "payload": pa.array(payload, pa.binary())})

    def compare(table):
        import pyarrow as pa

        blocks_ = table.column("block").to_numpy()
        got = [_unzip(x.as_py(), np.uint32, np.uint16, np.uint16, np.bool_, np.uint8) for x in table.column("payload")]
        string, n, anchor, many, text = (np.concatenate([g[i] for g in got]) for i in range(5))
        n, anchor = n.astype(np.int64), anchor.astype(np.int64)
        source = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
        del got
        owner = np.repeat(np.arange(len(n)), n)
        twice = repeated_windows(text, np.cumsum(n + k - 1) - (n + k - 1), n, anchor, k)
        twice |= many[owner]
        # runs of repeated windows within a string
        brk = np.zeros(len(owner), bool)
        brk[np.cumsum(n) - n] = True
        new = twice.copy()
        new[1:] &= ~twice[:-1] | brk[1:]
        first = np.flatnonzero(new)
        end = twice.copy()
        end[:-1] &= ~twice[1:] | brk[1:]
        length = np.flatnonzero(end) + 1 - first
        own = owner[first]
        to, payload = [], []
        for i in np.unique(source[own]):
            x = source[own] == i
            to.append(int(blocks_[i]))
            payload.append(_zip(string[own[x]], (first - (np.cumsum(n) - n)[own])[x].astype(np.uint16), length[x].astype(np.uint16)))
        return pa.table({"block": pa.array(to, pa.int32()), "payload": pa.array(payload, pa.binary()), "found": pa.array([True] * len(to), pa.bool_())})

    def finish(table, answers):
        import pyarrow as pa

        told = answers.column("found").to_numpy(zero_copy_only=False).astype(bool) if answers.num_rows else np.empty(0, bool)
        s = Strings(table, _values(answers.filter(pa.array(~told))), k, gram)
        n_str = len(s.windows)
        got = [_unzip(x.as_py(), np.uint32, np.uint16, np.uint16) for x in answers.filter(pa.array(told)).column("payload")]
        string, at, length = (np.concatenate([g[i] for g in got] or [np.empty(0, np.int64)]).astype(np.int64) for i in range(3))
        order = np.argsort(string, kind="stable")
        string, at, length = string[order], at[order], length[order]
        lo = np.searchsorted(string, np.arange(n_str))
        many = np.searchsorted(string, np.arange(n_str), "right") - lo
        # every occurrence of a string takes all of its runs
        each = many[s.string]
        run = ranges(lo[s.string], each)
        occ = np.repeat(np.arange(len(s.string)), each)
        start, size, chunk = s.first[occ] + at[run], length[run] + k - 1, s.chunk[occ]
        cols: dict[str, list] = {x: [] for x in ("n_bytes", "n_removed", "n_spans", "sha", "kept")}
        for i, (row, stop, data, to) in enumerate(s.parts):
            x = chunk == i
            d = np.bincount(start[x], minlength=len(data) + 1) - np.bincount(start[x] + size[x], minlength=len(data) + 1)
            gone = np.cumsum(d[:-1]) > 0
            c = np.concatenate([[0], np.cumsum(gone)])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]  # the newline between documents is never removed
            b = np.concatenate([[0], np.cumsum(begins)])
            cols["n_bytes"].append(np.diff(to) - 1)
            cols["n_removed"].append(np.diff(c[to]))
            cols["n_spans"].append(np.diff(b[to]))
            raw = data[~gone].tobytes()
            edge = to - c[to]
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                cols["sha"].append(hashlib.sha256(raw[a : z - 1]).hexdigest())
                if keep_bytes:
                    cols["kept"].append(raw[a : z - 1])
        cat = lambda x: pa.array(np.concatenate(cols[x]) if cols[x] else np.empty(0), pa.int64())
        out = {"doc_id": table.column("id")} | {x: cat(x) for x in ("n_bytes", "n_removed", "n_spans")} | {"kept_sha256": pa.array(cols["sha"], pa.string())}
        return pa.table(out | ({"kept": pa.array(cols["kept"], pa.binary())} if keep_bytes else {}))

    sent = base.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(send, "range long, block int, payload binary")
    answers = sent.groupBy("range").applyInArrow(compare, "block int, payload binary, found boolean")
    told = answers.unionByName(repeats.withColumn("found", F.lit(False)))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return base.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, schema)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_bytes(docs)
