"""Language ID, decontamination, URL filters and the pipeline."""

import random
import zlib

from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, url_filter

VOCAB = {"en": "the of and with thing ation ent whi", "fr": "le de les aux eau tion qué étre", "de": "der die und sch ein zu ung über", "ru": "и в на что это как его под"}


def text(rng, lang, n):
    parts = VOCAB[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(n))


def labelled(spark, rng, n=400):
    langs = list(VOCAB)
    rows = [(i, text(rng, langs[i % 4], rng.randrange(4, 60)), langs[i % 4]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(spark, clashing):
    rng = random.Random(1)
    df = labelled(spark, rng)
    model = langid.fit(df)
    got = langid.identify(clashing(df), model).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held) > 0
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... 5"), (4, "x"), (5, text(rng, "ru", 30000))], "doc_id long, text string")
    out = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[1]["score"] == 0
    assert out[4]["lang_pred"] in VOCAB and out[5]["lang_pred"] == "ru"
    assert langid.identify(odd.limit(0), model).count() == 0
    none = langid.identify(odd, langid.fit(df.limit(0))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_training_sample_is_never_empty(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, text(rng, "en", 20), "en") for i in range(3000)] + [(i, text(rng, "fr", 20), "fr") for i in range(3000, 3005)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "train", lambda got: got)
    hashed = dict(docs.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id"), 1)).collect())
    first = sorted((x for x in rows if x[2] == "en"), key=lambda x: hashed[x[0]])[:10]
    got = langid.fit(docs, held_out=None, per_lang=10)
    assert [x for x in got if x[1] == "en"] == [(x[1], "en") for x in first] and sum(x[1] == "fr" for x in got) == 5
    # one id throughout, whose only draw falls to none or to all
    same = langid.fit(docs.withColumn("doc_id", F.lit(1)), held_out=None, per_lang=10)
    assert sum(x[1] == "en" for x in same) == 10 and sum(x[1] == "fr" for x in same) == 5
    # a text over the bound comes first and leaves room for the others
    long = docs.withColumn("text", F.when(F.col("doc_id") == first[0][0], F.repeat(F.lit("word "), 5000)).otherwise(F.col("text")))
    some = [x for x in langid.fit(long, held_out=None, per_lang=10, most_bytes=16_000) if x[1] == "en"]
    assert len(some) == 10 and max(len(x[0]) for x in some) == 1000


def test_scripts_go_by_code_points():
    import unicodedata

    import numpy as np

    names = [None, *langid.SCRIPTS]
    words = {"Việt ề": "Latin", "ไทย": "Thai", "ქართ": "Georgian", "አማ": "Ethiopic", "हिन": "Devanagari", "தமி": "Tamil", "Ελλ": "Greek", "рус": "Cyrillic", "日本": "Han", "かな": "Kana", "한국": "Hangul", "עבר": "Hebrew", "عرب": "Arabic", "𠀀": "Han"}
    for text, want in words.items():
        data = np.frombuffer(text.lower().encode() + b"\n", np.uint8)
        w = langid.words_of(data, np.array([0, len(data)]))
        assert {names[i] for i in w.script} == {want}, text
        assert w.letters.sum() == len(text.replace(" ", ""))
    data = np.frombuffer("“—🙂×\n".encode(), np.uint8)
    w = langid.words_of(data, np.array([0, len(data)]))
    assert not w.letters.any() and not w.script.any()
    assert all(names[int(langid.script_of(np.array([i]))[0])] in (None, "Latin") for i in range(0x250) if unicodedata.category(chr(i))[0] == "L")


def test_spans_of_mixed_text(spark):
    rng = random.Random(2)
    model = langid.fit(labelled(spark, rng))
    mixed = text(rng, "en", 40) + " " + text(rng, "de", 60)
    r = langid.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model, spans=True).first()
    assert r["lang_pred"] == "de" and 0.4 < r["score"] < 0.8
    assert [s["lang"] for s in r["spans"]] == ["en", "de"] and sum(s["words"] for s in r["spans"]) == 100
    assert abs(r["spans"][0]["words"] - 40) <= 2


def test_labels_are_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    m = langid.Model(["a", "b", "c"], None, None, None, switch=2.0)
    for _ in range(30):
        sizes = rng.integers(1, 6, 3)
        doc = np.repeat(np.arange(3), sizes)
        s = rng.normal(0, 2, (len(doc), 3))
        got = langid.label(m, s, doc)
        for d in range(3):
            x = s[doc == d]

            def cost(p, x=x):
                return sum(x[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))

            assert abs(cost(got[doc == d]) - max(map(cost, itertools.product(range(3), repeat=len(x))))) < 1e-9


ITEM = "A farmer named Alice drove 120 km in 3 hours and later Alice walked 15 km more before she rested near the old mill"


def test_leaks(spark, clashing):
    bench = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, ""), (1, ITEM)], "item_id long, text string")
    fill = "Nothing here is of any interest to the benchmark at all and it goes on and on for many words."
    cases = {
        1: f"{fill} {ITEM} {fill}",
        2: f"{fill} " + ITEM.replace("Alice", "Bob").replace("120", "4,500").replace("15", "9"),
        3: f"{fill} " + ITEM.replace("named Alice", "named Bob"),  # one name stands for two: no consistent map
        4: fill,
        5: None,
        6: "",
        7: ITEM.replace(" km", " miles"),
        8: " ".join(ITEM.split()[:9]),
    }
    docs = spark.createDataFrame([*cases.items(), (1, cases[1]), (None, ITEM)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.leaks(clashing(docs), bench, window=13).collect()}
    assert set(got) == {1, 2, 7}
    assert not got[1]["reparameterised"] and got[2]["reparameterised"] and got[7]["reparameterised"]
    assert got[1]["n_windows"] == got[1]["item_windows"] == len(ITEM.split()) - 12
    shuffled = {r["doc_id"] for r in decontaminate.leaks(docs, bench, broadcast_rows=0).collect()}
    assert shuffled == set(got)
    kept = decontaminate.decontaminate(clashing(docs), bench)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 3, 4, 5, 6, 8] and kept.columns == clashing(docs).columns
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_in_any_case(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    fill = "Nothing here is of any interest to the benchmark."
    cases = [(1, f"{fill} {ITEM.upper()} {fill}"), (2, f"{fill} {ITEM.lower()} {fill}"), (3, f"{fill} {ITEM.title()}"), (4, fill.upper())]
    got = {r["doc_id"]: r for r in decontaminate.leaks(spark.createDataFrame(cases, "doc_id long, text string"), bench).collect()}
    assert set(got) == {1, 2, 3}
    assert all(r["n_windows"] == r["item_windows"] == len(ITEM.split()) - 12 and not r["reparameterised"] for r in got.values())


def test_leaks_of_few_literals(spark):
    bench = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "What is 12 times 15?"), (3, "12 kg 15 cm 3.5 km Alice Bob 7 8 9 10 11 12 hours 14")], "item_id long, text string")
    fill = "Nothing here is of any interest."
    cases = [
        (1, f"{fill} Who wrote Hamlet? {fill}"), (2, f"{fill} What is 12 times 15? {fill}"), (3, f"{fill} 12 kg 15 cm 3.5 km Alice Bob 7 8 9 10 11 12 hours 14. {fill}"),
        (4, f"{fill} Who wrote Macbeth? {fill}"), (5, f"{fill} What is 13 times 15? {fill}"), (6, f"{fill} 13 kg 15 cm 3.5 km Alice Bob 7 8 9 10 11 12 hours 14. {fill}"),
    ]
    docs = spark.createDataFrame(cases, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, bench).collect()}
    assert {(1, 1), (2, 2), (3, 3)} <= set(got) <= {(1, 1), (2, 2), (3, 3), (6, 3)}
    assert not any(r["reparameterised"] for r in got.values())
    assert (6, 3) not in got or got[6, 3]["n_windows"] < got[3, 3]["n_windows"]


def test_leaks_behind_any_text(spark):
    item = "What is the cost of 12 plain red bricks from Alice?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = item.replace("12", "30").replace("Alice", "Bob")
    cases = [(1, f"1) {item}"), (2, f"A heading\n{item}"), (3, f"A heading, {other}"), (4, other.replace("from ", "from  ")), (5, f"A heading\n\n{other}"), (6, item.replace("bricks", "tiles"))]
    got = {r["doc_id"]: r["reparameterised"] for r in decontaminate.leaks(spark.createDataFrame(cases, "doc_id long, text string"), bench).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: True}


def test_leaks_of_first_words(spark):
    items = [(1, "Alice has 3 apples and gives 2 apples to her best friend"), (2, "What is 2 plus 2?"), (3, "A train is late. Anna waits 5 minutes for it and Anna then walks home")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cases = [
        (1, "Bob has 7 apples and gives 4 apples to her best friend"), (2, "Then Bob has 7 apples and gives 4 apples to her best friend."), (3, "Well. What is 2 plus 2?"), (4, "What is 2 plus 3?"),
        (5, "A train is late. Maria waits 9 minutes for it and Maria then walks home"), (6, "A train is late. Maria waits 9 minutes for it and Paul then walks home"), (7, "Bob had 7 pears and gave 4 apples to her best friend"),
    ]
    docs = spark.createDataFrame(cases, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 1): True, (2, 1): True, (3, 2): False, (5, 3): True}


def test_leaks_read_the_documents_once(spark, tmp_path):
    items = [(1, "one two three"), (2, "four five six seven eight"), (3, ITEM), (4, "nine")]
    spark.createDataFrame([(1, "zero one two three four"), (2, ITEM)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    seen, real = [], decontaminate.stored

    def watch(df, name):
        seen.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("Relation [doc_id")))
        return real(df, name)

    decontaminate.stored, got = watch, None
    try:
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    finally:
        decontaminate.stored = real
    assert got == {(1, 1), (2, 3)} and dict(seen)["aligned"] == 1


def brute_leaks(docs, items, window=13, least=5):
    """(document, item) -> figures, by comparing every window with every window."""
    import regex

    def tokens(t):
        t = regex.sub("[\x01-\x04]", " ", t)
        t = regex.sub(r"(\p{N})[.,](\p{N})", r"\1\2", t)
        t = regex.sub(r"([^.!?:\s]\s+)(\p{Lu})", "\\1\x01\\2", t)
        t = regex.sub(r"(?<![\p{L}\p{N}\x01])(\p{Lu})", "\x04\\1", t)
        return [x for x in regex.split("[^\\p{L}\\p{N}\x01-\x04]+", t.lower()) if x]

    def bare(t):
        return t.lstrip("\x01\x04")

    def word(t):
        return "\x01" if t[0] == "\x01" else "\x03" if bare(t) in decontaminate.UNITS else regex.sub(r"\p{N}+", "\x02", bare(t))

    def readings(tok):
        a = [word(t) for t in tok]
        return a, ["\x01" if t[0] == "\x04" else x for t, x in zip(tok, a, strict=True)], [bare(t) for t in tok]

    out = {}
    for d, text in docs:
        dt = tokens(text or "")
        dr = readings(dt)
        for i, item in items:
            it = tokens(item or "")
            if not it or d is None or i is None:
                continue
            ir, w = readings(it), min(len(it), window)
            found = {}
            for p in range(len(dt) - w + 1):
                have = {tuple(x[p : p + w]) for x in dr}
                for q in range(len(it) - w + 1):
                    for k, x in enumerate(ir):
                        if tuple(x[q : q + w]) in have and (k == 2 or sum(t not in ("\x01", "\x02", "\x03") for t in x[q : q + w]) >= least):
                            found.setdefault(p - q, [set(), set()])[1].add(q)
                            if k == 0:
                                found[p - q][0].add(q)
            for shift, ways in found.items():
                for every, qs in enumerate(ways):
                    at = {q + j for q in qs for j in range(w)}
                    slots = [x for x in at if ir[0][x] in ("\x01", "\x02", "\x03") or (every and it[x][0] == "\x04")]
                    pairs = {(bare(it[x]), bare(dt[x + shift])) for x in slots}
                    if qs and len(pairs) == len({a for a, _ in pairs}):
                        out[d, i] = max(out.get((d, i), (0,)), (len(qs), len(it) - w + 1, len(slots), any(a != b for a, b in pairs)))
    return out


def test_leaks_are_those_of_brute_force(spark):
    rng = random.Random(12)
    vocab = "the of A river Alice Bob runs 12 3.5 km hours near old mill . ? , Then What is red cost plus 7".split()
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, prose(rng.choice([3, 8, 13, 14, 20, 30]))) for i in range(12)] + [(50, None), (51, "")]
    docs = []
    for d in range(60):
        t = prose(rng.randrange(0, 40))
        if d % 3 == 0:
            own = rng.choice(items[:12])[1]
            for a, b in rng.sample([("Alice", "Carol"), ("12", "40"), ("Bob", "Dan"), ("km", "miles"), ("river", "stream")], 2):
                own = own.replace(a, b)
            t += rng.choice([" ", ". ", "\n"]) + rng.choice([own, own.upper(), own.lower()]) + " " + prose(5)
        docs.append((d, t))
    docs += [(100, None), (101, "")]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=6, min_literals=3)
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["item_windows"], r["n_slots"], r["reparameterised"]) for r in got.collect()}
    want = brute_leaks(docs, items, 6, 3)
    assert len(want) > 10 and got == want


def test_pipeline_is_its_brute_force(spark, tmp_path):
    from collections import defaultdict

    import corpus_pipeline
    from test_exact import brute_groups, lower
    from tokenizers import Tokenizer

    from tessera.llm import best_fit

    rng = random.Random(8)
    langs = ["en", "fr", "de"]
    shared = [text(rng, "en", 6) for _ in range(5)]
    rows = []
    for i in range(70):
        lines = [text(rng, langs[i % 3], rng.randrange(1, 25)) for _ in range(rng.randrange(1, 4))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(shared))
        if i % 9 == 0:
            lines.append(ITEM.replace("Alice", rng.choice(["Alice", "Bob"])))
        if i % 5 == 4:
            copy = rows[rng.randrange(len(rows))][1].split(" ")
            copy[rng.randrange(len(copy))] = "changed"
            lines = [" ".join(copy)]
        rows.append((i, "\n".join(lines), langs[i % 3]))
    rows += [(200, "123 456", "en"), (201, None, None), (202, "", "en")]
    d = str(tmp_path)
    spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    docs = {i: t for i, t, _ in rows if t and any(c.isalpha() for c in t)}
    first, holders = {}, defaultdict(set)
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for i, t in docs.items():
        for x in map(key, t.split("\n")):
            if len(x) >= 10:
                first[x] = min(first.get(x, i), i)
                holders[x].add(i)
    docs = {i: "\n".join(x for x in t.split("\n") if len(holders[key(x)]) < 2 or first[key(x)] == i) for i, t in docs.items()}
    docs = {i: docs[i] for i, n, c in brute_groups(list(docs.items())) if n == 0 or c == i}
    bad = {x for x, _ in brute_leaks(list(docs.items()), [(1, ITEM)])}
    docs = {i: t for i, t in docs.items() if i not in bad}
    assert bad and len(docs) > 30
    t = Tokenizer.from_file(best_fit.default_tokenizer())
    got, seqs = defaultdict(int), defaultdict(list)
    for r in corpus_pipeline.run(spark, d).collect():
        got[r["doc_id"]] += r["length"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in docs.items()}
    for parts in seqs.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024


def test_urls(spark, clashing):
    day = "2024-0%d-01"
    events = [("Example.com", "block", day % 1), ("example.com", "lift", day % 3), ("a.example.com", "allow", day % 2), ("b.org/x", "block", day % 1), ("b.org", "allow", day % 1), ("b.org", "block", day % 1), (None, "block", day % 1)]
    ev = spark.createDataFrame(events, "key string, action string, d string").select("key", "action", F.to_date("d").alias("listed_at"))
    caps = [
        (1, "http://www.example.com/p?q", day % 1, "blocked", "example.com"), (2, "https://example.com:8080/", day % 3, "unlisted", None), (3, "http://u@A.example.com./", day % 2, "allowed", "a.example.com"),
        (4, "http://a.example.com", day % 1, "blocked", "example.com"), (5, "http://b.org/x/y", day % 1, "blocked", "b.org/x"), (6, "http://b.org/z", day % 1, "blocked", "b.org"), (7, None, day % 1, "unlisted", None),
        (8, "no url", day % 1, "unlisted", None), (9, "http://example.com/", None, "unlisted", None), (10, "http://notexample.com/", day % 1, "unlisted", None), (11, "http://example.com/", "2023-12-31", "unlisted", None),
        (1, "http://www.example.com/p?q", day % 1, "blocked", "example.com"),
    ]
    df = spark.createDataFrame([c[:3] for c in caps], "page_id long, url string, d string").select("page_id", "url", F.to_date("d").alias("fetched_at"))
    got = url_filter.url_filter(clashing(df), ev).collect()
    assert {(r["page_id"], r["verdict"], r["entry"]) for r in got} == {(c[0], c[3], c[4]) for c in caps} and len(got) == 11
    assert url_filter.url_filter(df.limit(0), ev).count() == 0
    assert {r["verdict"] for r in url_filter.url_filter(df, ev.limit(0)).collect()} == {"unlisted"}


def test_list_keys_follow_the_rules_of_urls(spark):
    events = [("Host.org/News/", "block", 1), ("WWW.Example.com", "block", 1), ("www.b.org./x", "allow", 1), ("host.org/sport", "block", 1)]
    caps = [
        (1, "http://www.host.org/News/1", "blocked", "host.org/News"), (2, "http://host.org/news/1", "unlisted", None), (3, "http://a.example.com/", "blocked", "example.com"),
        (4, "http://b.org/x/y", "allowed", "b.org/x"), (5, "http://HOST.org/sport", "blocked", "host.org/sport"),
    ]
    df = spark.createDataFrame([(*c[:2], 2) for c in caps], "page_id long, url string, fetched_at int")
    got = url_filter.url_filter(df, spark.createDataFrame(events, "key string, action string, listed_at int")).collect()
    assert {(r["page_id"], r["verdict"], r["entry"]) for r in got} == {(c[0], c[2], c[3]) for c in caps}


def test_pipeline_stages_keep_what_is_clean(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    langs = ["en", "fr", "de"]
    rows = [(i, text(rng, langs[i % 3], 60), langs[i % 3], "s", 0) for i in range(90)]
    rows += [(200, rows[3][1], "en", "s", 0), (201, "777 888", "en", "s", 0), (202, rows[6][1] + " " + ITEM, "en", "s", 0), (203, None, None, None, None)]
    shared = "This line is in two documents"
    rows[10] = (10, rows[10][1] + "\n" + shared, *rows[10][2:])
    rows[11] = (11, rows[11][1] + "\n" + shared, *rows[11][2:])
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == names
    every = {r[0] for r in rows}
    assert set(seen["language_id"]) == every - {201, 203}
    assert shared in seen["line_dedup"][10]["text"] and shared not in seen["line_dedup"][11]["text"]
    assert seen["line_dedup"][11]["n_chars"] == len(seen["line_dedup"][11]["text"])
    assert 202 in seen["near_duplicates"] and set(seen["near_duplicates"]) == every - {201, 203, 200} | ({200} if seen["line_dedup"][200]["text"] == "" else set())
    assert set(seen["decontamination"]) == set(seen["near_duplicates"]) - {202}
    assert set(seen["packing"]) == set(seen["decontamination"])
    assert corpus_pipeline.run(spark, d).count() == docs.count()
