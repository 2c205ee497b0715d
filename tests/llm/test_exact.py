"""Operators of exact contracts against brute force, with the awkward cases of each."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import best_fit, components, exact_topk, line_dedup, part_enum, sharding, suffixes, superkmers

SPACE = " \t\n\x0b\x0c\r"


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def split(text):
    return [w for w in __import__("re").split(f"[{SPACE}]+", text or "") if w]


# --- 1 ------------------------------------------------------------------------------------


def brute_lines(docs, least=10):
    first, many = {}, defaultdict(set)
    keys = lambda t: [(x, lower(x.strip(SPACE))) for x in (t or "").split("\n")]
    for i, t in docs:
        if i is None:
            continue
        for _, k in keys(t):
            if len(k) >= least:
                first[k] = min(first.get(k, i), i)
                many[k].add(i)
    out = []
    for i, t in docs:
        kept = [x for x, k in keys(t) if i is None or not (len(many.get(k, ())) >= 2 and i > first[k])]
        out.append((i, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def test_lines(docs_of, clashing):
    shared = "Everyone has this line"
    texts = [f"{shared}\nonly 0 here is it", f" {shared.upper()} \r\nÉcole normale sup", "école normale sup\nÉcole normale sup", None, "", f"{shared}\n{shared}\n", "short\nshort", "\n\n", "a" * 5000]
    data = [*enumerate(texts), (5, texts[5]), (2, "other text of two\n" + shared), (None, shared)]
    df = docs_of(data)
    got = line_dedup.line_dedup(clashing(df))
    assert set(df.columns) | {"n_lines", "n_dropped"} <= set(got.columns)
    assert rows(got.withColumn("s", F.sha2("text", 256)), "doc_id", "n_lines", "n_dropped", "s") == brute_lines(data)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


# --- 2 ------------------------------------------------------------------------------------


def test_top_k(spark, clashing):
    rng = random.Random(5)
    vec = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    vec += [(1000, vec[0][1]), (1001, vec[0][1]), (1002, None), (1003, [1.0, None] + [0.0] * 4), (1004, [float("nan")] * 6), (1005, [float("inf")] * 6), (1006, [0.0] * 6)]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<float>")
    import numpy as np

    ok = {i: np.floor(np.float32(v).astype(float) * 1024).astype(int) for i, v in vec if v and None not in v and np.isfinite(v).all()}
    want = []
    for q in (x for x in ok if x % 100 == 0):
        s = sorted(((-int(ok[q] @ v), i) for i, v in ok.items() if i != q))[:7]
        want += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    got = exact_topk.top_k(df.union(df.limit(3)), df.where("vec_id % 100 = 0"), 7, shard_rows=50, block_rows=2)
    assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=str)
    assert rows(exact_topk.top_k(clashing(df), df.where("vec_id % 100 = 0"), 7, shard_rows=50, sample_rows=60), "query_id", "rank", "vec_id", "score") == sorted(want, key=str)
    mixed = df.union(spark.createDataFrame([(2000 + i, [float(i), 1.0]) for i in range(30)], df.schema))
    got = exact_topk.top_k(mixed, mixed.where("vec_id in (100, 2003)"), 7, shard_rows=20)
    assert rows(got.where("query_id = 100"), "query_id", "rank", "vec_id", "score") == sorted([x for x in want if x[0] == 100], key=str)
    assert rows(got.where("query_id = 2003"), "rank", "vec_id") == [(i + 1, 2029 - i) for i in range(7)]
    few = df.where("vec_id in (0, 3)")
    assert rows(exact_topk.top_k(few, few.where("vec_id = 0")), "query_id", "rank", "vec_id") == [(0, 1, 3)]
    assert exact_topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_queries_go_only_where_a_root_box_reaches(spark):
    boxes = [(2, i, [float(10 * i), 0.0], [10.0 * i + 5, 1.0]) for i in range(3000)]
    b = spark.createDataFrame(boxes, "dim int, shard long, lo array<double>, hi array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0], 2, 0, 2990 * 10 * 1024.0, 2995), (2, [-1.0, 0.0], 2, 1, None, 5), (3, [1.0], 1, 0, 0.0, 5)], "id long, v array<double>, dim int, block int, kth double, shard long")
    got = exact_topk.reached(q, b)
    assert [r["shard"] for r in got.where("id = 1").orderBy("shard").collect()] == [2990, *range(2991, 2995), *range(2996, 3000)]
    assert got.where("id = 2").count() == 2999 and got.where("id = 3").count() == 0


# --- 4 ------------------------------------------------------------------------------------


def test_tokens_are_those_of_the_library(docs_of):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(best_fit.default_tokenizer())
    texts = ["Hello  world\n\n x", "it's we'll 'quoted'", "a\t b  c ", "", None, "  ", "É ñandú 12 34.5!", "日本語 text", "x" * 3000, "end\n", "<|endoftext|> a", " \n a", "two words " * 900]
    enc = best_fit.Encoder(best_fit.default_tokenizer())
    ids, counts = enc.encode([x or "" for x in texts])
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]
    got = best_fit.token_pieces(docs_of(texts), best_fit.default_tokenizer(), with_ids=True).orderBy("doc_id", "piece").collect()
    back = defaultdict(list)
    for r in got:
        assert r["start"] == len(back[r["doc_id"]]) and r["length"] == len(r["ids"]) <= 1024
        raw = b"".join(x.to_bytes(4, "little") for x in r["ids"])
        assert r["ids_crc32"] == zlib.crc32(raw)
        back[r["doc_id"]] += r["ids"]
    assert [back[i] for i in range(len(texts))] == [x + [2] for x in want]


def morse(n: int, one: str = "a", two: str = "b") -> str:
    """A Thue-Morse word: against its complement it meets in any polynomial hash modulo 2**64."""
    return "".join((one, two)[bin(i).count("1") % 2] for i in range(n))


def test_morse_words_are_told_apart(docs_of):
    from tokenizers import Tokenizer

    x, y = morse(2048), morse(2048, "b", "a")
    t = Tokenizer.from_file(best_fit.default_tokenizer())
    ids, counts = best_fit.Encoder(best_fit.default_tokenizer()).encode([x, y, f"{x} {y}"])
    want = [t.encode(i, add_special_tokens=False).ids for i in (x, y, f"{x} {y}")]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(i) for i in want]

    same = "one two three four five six seven eight nine ten eleven twelve"
    data = [(1, f"{same} {x}"), (2, f"{same} {y}"), (3, f"{same} {x}")]
    got = superkmers.repeated_words(docs_of(data))
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(data, 13)
    code = [(i, " ".join(morse(2048, *w).split())) for i, w in ((4, ("a ", "b ")), (5, ("b ", "a ")))]
    assert rows(superkmers.repeated_words(docs_of(code)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(code, 13)

    data = [(1, x), (2, y), (3, x.upper()), *code]
    assert rows(part_enum.near_duplicates(docs_of(data)), "doc_id", "n_shingles", "component_id") == brute_groups(data)

    data = [(1, x), (2, y), (3, x + "c"), (4, morse(2048, "é", "è"))]
    got = suffixes.repeated_bytes(docs_of(data))
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(data, 400)


def test_added_tokens_have_their_id(docs_of):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(best_fit.default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "it's<|endoftext|><|endoftext|>\n日本", "plain", "<|endoftext", "é <|endoftext|>"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[0] == [64, 220, 50256, 275]
    ids, counts = best_fit.Encoder(best_fit.default_tokenizer()).encode(texts)
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]
    got = best_fit.token_pieces(docs_of(texts), best_fit.default_tokenizer(), with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: [*x, 2] for i, x in enumerate(want)}


def test_plan_uses_exact_complements():
    p = best_fit.plan({600: 3, 424: 2, 300: 1, 124: 1, 1024: 2, 1: 1})
    assert Counter({k: n for k, n in p}) == Counter({(1024,): 2, (600, 424): 2, (600, 300, 124): 1, (1,): 1})
    rng = random.Random(1)
    for _ in range(20):
        c = Counter(rng.randrange(1, 1025) for _ in range(rng.randrange(1, 400)))
        p = best_fit.plan(c)
        used = Counter()
        for lengths, m in p:
            assert sum(lengths) <= 1024
            for x in lengths:
                used[x] += m
        assert used == c
        assert sum(m for _, m in p) <= 1.1 * sum(k * n for k, n in c.items()) / 1024 + 2


def test_complements_are_found_while_the_counts_allow():
    import numpy as np

    rng = random.Random(9)
    for _ in range(40):
        count = np.zeros(61, np.int64)
        for _ in range(rng.randrange(1, 12)):
            count[rng.randrange(1, 61)] += rng.randrange(1, 3)
        index = best_fit.Complements(count)
        while count.any():
            for gap in range(1, 61):
                has = [n for n in range(1, 61) for _ in range(min(count[n], 3))]
                could = gap in has or any(a + b == gap for i, a in enumerate(has) for b in has[i + 1 :])
                could = could or any(has[i] + has[j] + has[m] == gap for i in range(len(has)) for j in range(i) for m in range(j))
                got = index.fill(count.copy(), gap)
                assert bool(got) == could and sum(got) == gap * could and all(Counter(got)[n] <= count[n] for n in got)
            count[rng.choice(np.flatnonzero(count).tolist())] -= 1


def test_sequences_are_gapless(docs_of):
    rng = random.Random(2)
    docs = docs_of([" ".join(rng.choice(["alpha", "beta", "x1"]) for _ in range(rng.randrange(0, 900))) for _ in range(150)])
    got = best_fit.pack(best_fit.token_pieces(docs.union(docs.limit(3)), best_fit.default_tokenizer()))
    seqs = defaultdict(list)
    for r in got.collect():
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert best_fit.pack(best_fit.token_pieces(docs.limit(0), best_fit.default_tokenizer())).count() == 0


# --- 5 ------------------------------------------------------------------------------------


def brute_words(docs, k):
    first = {}
    for i, t in docs:
        w = split(t)
        if i is not None:
            for j in range(len(w) - k + 1):
                x = tuple(w[j : j + k])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, t in docs:
        w = split(t)
        gone = set()
        if i is not None:
            for j in range(len(w) - k + 1):
                if first[tuple(w[j : j + k])] < i:
                    gone |= set(range(j, j + k))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), sha(" ".join(kept))))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_words(docs_of, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["a", "b", "cé", "dd"]) for _ in range(40)) for _ in range(12)]
    data = []
    for i in range(50):
        parts = [x[a : a + rng.randrange(0, 60)] for x in rng.sample(pool, rng.randrange(0, 4)) for a in [rng.randrange(0, 30)]]
        data.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    data += [(100, None), (101, ""), (102, "z " * 200), (103, "z " * 150), (None, pool[0]), (3, data[3][1]), (7, pool[1])]
    got = superkmers.repeated_words(docs_of(data), k=6, m=2, block_bytes=1500, keep_text=True)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(data, 6)
    assert all(sha(r["kept"]) == r["kept_sha256"] for r in got.collect())
    assert superkmers.repeated_words(docs_of([])).count() == 0


# --- 6 ------------------------------------------------------------------------------------


def test_sharding_moves_rows_only_into_the_new_shard(docs_of):
    docs = docs_of([(i, f"t{i}") for i in range(3000)] + [(5, "again"), (None, None), (None, "é")])
    got = sharding.shard_documents(docs, sharding.topology(40), sharding.topology(41)).collect()
    for r in got:
        assert r["grown_shard"] in (r["shard"], 40)
        t = "" if r["doc_id"] is None and r["size"] == 16 else None
        if t is not None:
            assert r["text_crc32"] == 0
    assert sum(r["grown_shard"] == 40 for r in got) == pytest.approx(3000 / 41, rel=0.5)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(by) == 40 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1


def test_weights_move_rows_only_into_what_has_grown(docs_of):
    docs = docs_of([(i, "x") for i in range(4000)])
    base = sharding.topology(12, per_rack=2)  # regions of two racks of two shards
    heavy = [sharding.Shard(s.shard, s.rack, s.region, 2.0 if s.shard == 3 else 1.0) for s in base]
    at = [{r["doc_id"]: r for r in sharding.shard_documents(docs, t).collect()} for t in (base, heavy)]
    moved = 0
    for i, a in at[0].items():
        b = at[1][i]
        moved += a["shard"] != b["shard"]
        if a["region"] != b["region"]:
            assert b["region"] == 0
        elif a["rack"] != b["rack"]:
            assert b["rack"] == 1
        elif a["shard"] != b["shard"]:
            assert b["shard"] == 3
    assert 0 < moved < 4000 * 0.2
    assert sum(r["shard"] == 3 for r in at[1].values()) / 4000 == pytest.approx(2 / 13, abs=0.03)
    assert sum(r["rack"] == 1 for r in at[1].values()) / 4000 == pytest.approx(3 / 13, abs=0.03)
    closed = [sharding.Shard(s.shard, s.rack, s.region, 0.0 if s.rack == 1 else 1.0) for s in base]
    gone = {r["doc_id"]: r for r in sharding.shard_documents(docs, closed).collect()}
    assert all(r["rack"] != 1 for r in gone.values())
    # the region has lost weight: rows leave it or move within it, and none comes in
    assert all(gone[i]["shard"] == a["shard"] for i, a in at[0].items() if a["region"] != 0)
    assert sharding.shard_documents(docs.limit(0), base).count() == 0
    with pytest.raises(ValueError):
        sharding.place(F.col("doc_id"), [sharding.Shard(0, 0, 0, 0.0)])


# --- 8 ------------------------------------------------------------------------------------


def shingles(t):
    w = [lower(x) for x in split(t)]
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_groups(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates(docs_of, seed, monkeypatch):
    monkeypatch.setattr(part_enum, "_CROWD", 4)  # so that crowded signatures occur
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    data, i = [], 0
    for _ in range(14):
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 9, 20, 60, 200]))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.choice([1, 2, 8])):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            data.append((i, rng.choice([" ", "\n"]).join(w)))
            i += 1
    rng.shuffle(data)
    data += [(900, None), (901, ""), (902, " \n "), (903, "One"), (904, "one"), (905, "a b c d"), (None, "A b C d"), (3, "three three"), (905, "a b c d")]
    got = part_enum.near_duplicates(docs_of(data), block_bytes=3000, piece=3)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_groups(data)


def test_one_of_each(docs_of, clashing):
    w = [f"w{i}" for i in range(60)]
    data = [(4, " ".join(w)), (2, " ".join([*w[:-1], "x"])), (9, "alone here"), (7, None), (8, ""), (9, "alone here"), (None, "only this null")]
    df = clashing(docs_of(data)).drop("text_h")
    got = part_enum.one_of_each(df)
    assert got.columns == df.columns
    assert rows(got, "doc_id", "text") == sorted([(2, data[1][1]), (9, "alone here"), (7, None), (8, ""), (None, "only this null")], key=str)
    assert part_enum.near_duplicates(docs_of([])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges for x in e if e[0] != e[1] or find(x) != x}
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and set(got) == {x for e in edges if e[0] != e[1] for x in e}


# --- 9 ------------------------------------------------------------------------------------


def brute_bytes(docs, k):
    count = Counter()
    for _, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - k + 1):
            count[b[i : i + k]] += 1
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - k + 1):
            if count[b[i : i + k]] > 1:
                gone[i : i + k] = [True] * k
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return sorted(out, key=str)


def test_multikey_sort_is_the_order_of_bytes():
    import os

    import numpy as np

    rng = random.Random(6)
    for _ in range(200):
        strings = []
        for _ in range(rng.randrange(0, 60)):
            if strings and rng.random() < 0.5:
                strings.append(rng.choice(strings)[: rng.randrange(0, 40)] + rng.choice([b"", b"ab", b"\x00", b"ba" * 9]))
            else:
                strings.append(bytes(rng.choice(b"abc\x00\xff") for _ in range(rng.randrange(0, 30))))
        size = np.array([len(x) for x in strings], np.int64)
        order, common = suffixes.multikey_sort(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size)
        got = [strings[i] for i in order]
        assert got == sorted(strings)
        assert common[1:].tolist() == [len(os.path.commonprefix(p)) for p in zip(got, got[1:], strict=False)]


@pytest.mark.parametrize("gram", [8, 40])
def test_bytes(docs_of, gram):
    rng = random.Random(gram)
    pool = ["".join(rng.choice("abcé\n ") for _ in range(300)) for _ in range(20)]
    data = [(i, "".join(x[a : a + rng.randrange(0, 120)] for x in rng.sample(pool, rng.randrange(0, 4)) for a in [rng.randrange(0, 200)])) for i in range(50)]
    data += [(100, None), (101, ""), (102, "a" * 300), (103, "ab" * 200), (3, data[3][1]), (None, pool[0])]
    got = suffixes.repeated_bytes(docs_of(data), k=40, gram=gram, block_bytes=2000, keep_bytes=True)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(data, 40)
    assert all(sha(bytes(r["kept"])) == r["kept_sha256"] for r in got.collect())
    assert suffixes.repeated_bytes(docs_of([])).count() == 0


# --- all ----------------------------------------------------------------------------------


def test_other_columns_change_nothing(docs_of, clashing):
    same = " ".join(f"word{i}" for i in range(90))
    data = [(1, same), (2, f"{same} end"), (3, None), (4, ""), (2, "again"), (None, same)]
    inner = ("__bucket", "__rank", "__len", "__seq", "__g", "__b", "__r", "__o", "bucket", "size", "n_words", "kept", "piece", "at", "n", "f1", "component_id", "sequence_id", "offset", "length")
    plain = docs_of(data)
    odd = clashing(plain).withColumns({c: F.lit("x") for c in inner})

    def packed(df):
        pieces = best_fit.token_pieces(df, best_fit.default_tokenizer())
        return best_fit.pack(pieces)

    for f in (superkmers.repeated_words, part_enum.near_duplicates, suffixes.repeated_bytes, packed, lambda d: sharding.shard_documents(d, sharding.topology(4))):
        a = f(plain)
        assert rows(f(odd), *a.columns) == rows(a, *a.columns)
    pieces = best_fit.token_pieces(plain, best_fit.default_tokenizer())
    wide = best_fit.pack(pieces.withColumns({c: F.lit("x") for c in ("__bucket", "__rank", "__len", "__lo", "__seq", "__g", "__b", "offset")}))
    assert set(pieces.columns) | {"__bucket", "__rank", "__seq", "offset", "sequence_id"} <= set(wide.columns)
    assert rows(wide, *pieces.columns, "sequence_id", "offset") == rows(best_fit.pack(pieces), *pieces.columns, "sequence_id", "offset")


def test_very_long_texts(docs_of):
    words = [f"w{i * 7919 % 100003}" for i in range(60_000)]
    data = [(1, " ".join(words)), (2, " ".join(words[30_000:])), (3, " ".join(words[:59_000])), (4, "x" * 300_000), (5, "x" * 299_999), (6, "short")]
    got = superkmers.repeated_words(docs_of(data), block_bytes=100_000)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(data, 13)
    assert rows(part_enum.near_duplicates(docs_of(data), block_bytes=100_000), "doc_id", "n_shingles", "component_id") == brute_groups(data)
    assert rows(line_dedup.line_dedup(docs_of(data)).withColumn("s", F.sha2("text", 256)), "doc_id", "n_lines", "n_dropped", "s") == brute_lines(data)
    few = [(1, data[0][1][:60_000]), (2, data[0][1][20_000:90_000]), (3, "x" * 20_000), (4, "é" * 20_000)]
    got = suffixes.repeated_bytes(docs_of(few), block_bytes=10_000)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(few, 400)
    sizes = {r["doc_id"]: r["n"] for r in best_fit.token_pieces(docs_of(data), best_fit.default_tokenizer()).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(best_fit.default_tokenizer())
    assert sizes == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in data}
