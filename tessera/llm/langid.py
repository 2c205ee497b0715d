"""Language identification of mixed-language text.

Each word gets a score for every language from byte n-grams; the scripts of its
characters narrow which languages can have it.  A Viterbi pass with a switching penalty
turns the scores into labelled spans.  Texts where no detour can pay for its penalty
(shown by a largest-subarray bound) need no pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import few_at_once, lean, ranges, text_chunks

_TRI, _PENTA = 1 << 16, 1 << 18
#: Code points of scripts (blocks of the Unicode standard); what is in none
#: of them is no letter of a script and says nothing about a language.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F), (0xFB13, 0xFB17)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE)],
    "Syriac": [(0x700, 0x74F)],
    "Thaana": [(0x780, 0x7BF)],
    "Devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Oriya": [(0xB00, 0xB7F)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "Ethiopic": [(0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F)],
    "Cherokee": [(0x13A0, 0x13FF), (0xAB70, 0xABBF)],
    "Khmer": [(0x1780, 0x17FF)],
    "Mongolian": [(0x1800, 0x18AF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "Han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
_RANGES = sorted((lo, hi, i + 1) for i, parts in enumerate(SCRIPTS.values()) for lo, hi in parts)
_LOW, _HIGH, _WHICH = (np.array(x) for x in zip(*_RANGES, strict=True))

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65], _FOLD[91:97], _FOLD[123:128] = 32, 32, 32
_ASCII = np.zeros(256, np.uint8)
_ASCII[97:123] = 1


def script_of(points: np.ndarray) -> np.ndarray:
    """The number of each code point's script, 0 for none."""
    i = np.maximum(np.searchsorted(_LOW, points, "right") - 1, 0)
    return np.where((points >= _LOW[i]) & (points <= _HIGH[i]), _WHICH[i], 0).astype(np.uint8)


def scripts_of(data: np.ndarray, folded: np.ndarray) -> np.ndarray:
    """The script of the character that starts at each byte of UTF-8, 0 within one."""
    out = _ASCII[folded]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        first = data[lead].astype(np.int64)
        more = [data[np.minimum(lead + i, len(data) - 1)].astype(np.int64) & 63 for i in (1, 2, 3)]
        two = (first & 31) << 6 | more[0]
        three = (first & 15) << 12 | more[0] << 6 | more[1]
        four = (first & 7) << 18 | more[0] << 12 | more[1] << 6 | more[2]
        out[lead] = script_of(np.where(first < 0xE0, two, np.where(first < 0xF0, three, four)))
    return out


@dataclass
class Words:
    """Folded words of a chunk of texts."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # which text
    tri: np.ndarray  # n-gram codes of every byte
    penta: np.ndarray
    letters: np.ndarray
    script: np.ndarray


def words_of(data: np.ndarray, to: np.ndarray) -> Words:
    d = _FOLD[data]
    after = np.zeros(len(d), bool)
    after[1:] = data[:-1] == 0xC3
    d[after & (data >= 0x80) & (data <= 0x9E)] += 0x20  # À-Þ
    gap = np.ones(len(d) + 2, bool)
    gap[1:-1] = d == 32
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    s, e = turn[::2], turn[1::2]
    p = np.full(len(d) + 4, 32, np.uint32)
    p[2:-2] = d
    tri = ((p[1:-3] << 16 | p[2:-2] << 8 | p[3:-1]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    wide = (p[:-4].astype(np.uint64) << np.uint64(32)) | (p[1:-3] << 24 | p[2:-2] << 16 | p[3:-1] << 8 | p[4:])
    penta = ((wide * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.uint32)
    own = scripts_of(data, d)
    letters = np.concatenate([[0], np.cumsum(own > 0)])
    script = np.maximum.reduceat(own, s) if len(s) else np.empty(0, np.uint8)
    return Words(s, e, np.searchsorted(to, s, "right") - 1, tri, penta, letters[e] - letters[s], script)


@dataclass
class Model:
    langs: list[str]
    tri: np.ndarray  # [code, language] log probabilities
    penta: np.ndarray
    scripts: np.ndarray  # [script, language] may it occur; none (0) may in all
    switch: float = 10.0
    most: float = 12.0  # of a single word's lead

    def scores(self, w: Words) -> np.ndarray:
        if not len(w.start):
            return np.empty((0, len(self.langs)))
        inside = ranges(w.start, w.end - w.start)
        at = np.concatenate([[0], np.cumsum(w.end - w.start)[:-1]])
        s = np.add.reduceat(self.tri[w.tri[inside]] + self.penta[w.penta[inside]], at, axis=0).astype(np.float64)
        s -= s.max(1, keepdims=True)
        may = self.scripts[w.script]
        s[~may & may.any(1, keepdims=True)] = -self.most
        return np.maximum(s, -self.most)


def train(texts: list[tuple[str, str]], **how) -> Model:
    """Fit on (text, language) pairs: smoothed n-gram log probabilities and the scripts
    that make up at least one word in a thousand."""
    import pyarrow as pa

    langs = sorted({lang for _, lang in texts})
    tri, penta = np.full((_TRI, len(langs)), 0.5), np.full((_PENTA, len(langs)), 0.2)
    scripts = np.zeros((len(SCRIPTS) + 1, len(langs)))
    for k, lang in enumerate(langs):
        table = pa.table({"text": pa.array([t for t, x in texts if x == lang], pa.large_string())})
        for _, _, data, to in text_chunks(table):
            w = words_of(data, to)
            inside = ranges(w.start, w.end - w.start)
            tri[:, k] += np.bincount(w.tri[inside], minlength=_TRI)
            penta[:, k] += np.bincount(w.penta[inside], minlength=_PENTA)
            scripts[:, k] += np.bincount(w.script, minlength=len(scripts))
    norm = [np.log(x / x.sum(0)).astype(np.float32) for x in (tri, penta)]
    may = scripts >= np.maximum(1, 0.001 * scripts.sum(0))
    may[0] = True
    return Model(langs, norm[0], norm[1], may, **how)


def label(model: Model, s: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The best sequence of languages for the words of each text; ``text`` is sorted."""
    out = np.empty(len(s), np.int64)
    if not len(s):
        return out
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    size = np.diff(np.append(first, len(s)))
    total = np.add.reduceat(s, first, axis=0)
    lead = total.argmax(1)
    doc = np.repeat(np.arange(len(first)), size)
    out[:] = lead[doc]
    # the most that leaving the leading language for a run of words could gain
    own = s[np.arange(len(s)), out]
    other = s.copy()
    other[np.arange(len(s)), out] = -np.inf
    gain = (other.max(1) - own) if s.shape[1] > 1 else np.full(len(s), -1.0)
    c = np.cumsum(gain)
    drop = -4.0 * (np.abs(c).max() + 1.0) * doc
    low = np.minimum.accumulate((c - gain) + drop) - drop
    best = np.maximum.reduceat(c - low, first)
    hard = np.flatnonzero(best > model.switch)
    if len(hard):
        hard = hard[np.argsort(-size[hard], kind="stable")]
        n, at = size[hard], first[hard]
        back = {}
        dp = s[at].copy()
        for t in range(1, int(n[0])):
            live = int(np.searchsorted(-n, -t, "left"))
            v = dp[:live]
            top = v.argmax(1)
            jump = v[np.arange(live), top] - model.switch
            move = jump[:, None] > v
            back[t] = np.where(move, top[:, None], np.arange(s.shape[1])).astype(np.int8)
            dp[:live] = np.maximum(v, jump[:, None]) + s[at[:live] + t]
        state = dp.argmax(1)
        out[at + n - 1] = state
        for t in range(int(n[0]) - 1, 0, -1):
            live = len(back[t])
            state[:live] = back[t][np.arange(live), state[:live]]
            out[at[:live] + t - 1] = state[:live]
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int | None = 5, per_lang: int = 600, most_bytes: int = 8 << 20) -> Model:
    """Train on a bounded sample of labelled rows: the ``per_lang`` of least hash of each
    language, and ``most_bytes`` characters of text of each at most.  A text gives its
    first sixteenth of that bound at most, so none shuts out the others of its language.
    Rows with crc32(id) mod ``held_out`` = 0 are never used."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    if held_out:
        rows = rows.where(F.crc32(F.col("id").cast("string").cast("binary")) % held_out != 0)
    rows = rows.withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit(3), "id"), 1))
    # the leading bit of a draw and the four bits behind it: about 1,000 classes at any number of rows
    rows = rows.withColumn("class", F.floor(F.log2(F.col("draw") + F.lit(1.0)) * 16).cast("int"))
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in rows.groupBy("lang", "class").agg(F.count(F.lit(1)).alias("n")).collect():  # at most 1,009 rows a language
        counts.setdefault(r["lang"], []).append((r["class"], r["n"]))
    want = F.lit(False)
    for lang, classes in counts.items():
        upto, last = 0, 0
        for last, n in sorted(classes):
            upto += n
            if upto >= per_lang:
                break
        want = want | ((F.col("lang") == lang) & (F.col("class") <= last))
    least = Window.partitionBy("lang").orderBy("draw", "id", "text")
    share = max(1, most_bytes // 16)
    drawn = rows.where(want).select("id", "lang", "draw", F.substring("text", 1, share).alias("text"))
    drawn = drawn.withColumn("place", F.row_number().over(least)).where(F.col("place") <= per_lang)
    got, used = [], {}
    for r in drawn.select("text", "lang", "place").sortWithinPartitions("lang", "place").toLocalIterator():
        text = r["text"][: most_bytes - used.get(r["lang"], 0)]
        if text:
            used[r["lang"]] = used.get(r["lang"], 0) + len(text)
            got.append((text, r["lang"]))
    return train(got)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """Add ``lang_pred``, ``score`` and, if asked for, ``spans`` to the columns of ``docs``.

    ``lang_pred`` is the label with most letters, ``score`` its share of the letters
    times its posterior for the whole text.  Spans are (first word, words, language).
    Text that is null or has no letters is ``und`` with score 0, and so is all text if
    no language was learned.  Columns with the names of results are replaced.  Of equal
    shares the first language by name counts.  Repeated rows get the same label each; a
    text, of any length, is labelled whole by one task; an empty table gives an empty one.
    """
    extra = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    langs = model.langs
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: tables of fixed size for each language
    more = ", spans array<struct<first:int,words:int,lang:string>>" if spans else ""
    src = docs.select(F.struct(*extra).alias("row"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("has"))

    def predict(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        m = shared.value
        for batch in few_at_once(batches):
            n = batch.num_rows
            pred, score, found = np.full(n, -1), np.zeros(n), [None] * n
            table = pa.table({"text": pc.if_else(batch.column(1), pc.struct_field(batch.column(0), text_col), "")})
            if langs:
                for a, b, data, to in text_chunks(table, 1 << 19):
                    w = words_of(data, to)
                    s = m.scores(w)
                    own = label(m, s, w.text)
                    share = np.zeros((b - a, len(langs)))
                    np.add.at(share, (w.text, own), np.maximum(w.letters, 1e-3))
                    total = np.zeros((b - a, len(langs)))
                    np.add.at(total, w.text, s)
                    some = share.sum(1) > 0
                    best = share.argmax(1)
                    odds = np.exp(np.maximum(total - total.max(1, keepdims=True), -700))
                    rows = np.arange(b - a)
                    part = share[rows, best] / np.maximum(share.sum(1), 1e-9)
                    # a text of several languages is as sure as its share says
                    sure = np.where(part < 1, 1.0, odds[rows, best] / odds.sum(1))
                    pred[a:b] = np.where(some, best, -1)
                    score[a:b] = np.where(some, part * sure, 0.0)
                    if spans and len(own):
                        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (w.text[1:] != w.text[:-1])]))
                        base = np.searchsorted(w.text, w.text[new], "left")
                        for i, x, k in zip(new, base, np.diff(np.append(new, len(own))), strict=True):
                            at = a + int(w.text[i])
                            found[at] = found[at] or []
                            found[at].append({"first": int(i - x), "words": int(k), "lang": langs[own[i]]})
            cols = [batch.column(0), pa.array([langs[i] if i >= 0 else "und" for i in pred]), pa.array(score)]
            fields = ["row", "lang_pred", "score"]
            if spans:
                cols.append(pa.array([x or [] for x in found], pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))))
                fields.append("spans")
            yield pa.RecordBatch.from_arrays(cols, fields)

    from pyspark.sql import types as T

    schema = T.StructType([src.schema["row"], *T._parse_datatype_string(f"lang_pred string, score double{more}").fields])
    out = src.mapInArrow(lean(predict), schema)
    return out.select("row.*", *[c for c in out.columns if c != "row"])


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select("doc_id", "text", "lang"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
