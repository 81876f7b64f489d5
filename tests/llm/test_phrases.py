import random
import re
from collections import Counter, defaultdict

import numpy as np

from tidewatch.llm import phrases

SCHEMA = "doc_id long, text string, lang string, words string, n string, node string"


def plain_counts(rows, most=4):
    f = defaultdict(Counter)
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return f


def plain_version(rows, least, keep=2000, most=4, overlap=80):
    out = []
    for lang, f in plain_counts(rows, most).items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cand.items():
            if any(100 * b >= overlap * a for q, b in cand.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))):
                continue
            cuts = [(2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(c for p, c in f.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:keep])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", "z") for i, (lang, t) in enumerate(rows)], SCHEMA)


def random_rows(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "c", "Émile", "été", "the", "THE", "of", "x y", "😀", *(f"w{i}" for i in range(30))]
    def text():
        out = []
        for _ in range(rng.randint(0, 25)):
            out.append(rng.choice(["the end of a", "of the of the of the", "a b c", rng.choice(words), rng.choice(words), rng.choice(words)]))
            out.append(rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "?!", "\r\n", " ; "]))
        return "".join(out)
    return [(rng.choice(["en", "fr", None, "und"]), rng.choice([None, ""]) if i % 40 == 0 else text()) for i in range(n)]


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_the_plain_version(spark):
    rows = random_rows(1, 400)
    for least, keep in ((3, 2000), (30, 7)):
        got = collected(phrases.collocations(frame(spark, rows), least, keep=keep))
        assert got == plain_version(rows, least, keep) and len(got) > 10


def test_full_bitmaps_and_dealt_prefixes_change_nothing(spark, monkeypatch):
    rows = random_rows(2, 300) + [("en", "of the " * 3 + w) for w in ("one two", "two", "x y", "z") for _ in range(20)]
    want = plain_version(rows, 4)
    for name, value in (("WORD_BITS", 6), ("PAIR_BITS", 6), ("BUDGET", 3), ("HOT", 1)):
        monkeypatch.setattr(phrases, name, value)
        assert collected(phrases.collocations(frame(spark, rows), 4)) == want, name


def test_other_depths(spark):
    rows = random_rows(3, 200)
    for most in (2, 3, 5):
        assert collected(phrases.collocations(frame(spark, rows), 3, max_words=most)) == plain_version(rows, 3, most=most)


def test_no_phrase_and_no_row(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [("en", "one two three"), (None, None), ("fr", " . , ")])).collect() == []


def test_colliding_words_start_over_with_another_seed(spark, monkeypatch):
    rows, real, seeds = random_rows(4, 100), phrases.word_counts, []

    def collides(docs, seed):
        seeds.append(seed)
        w = real(docs, seed)
        return w.withColumn("hash", w["hash"] * 0) if seed == 1 else w

    monkeypatch.setattr(phrases, "word_counts", collides)
    assert collected(phrases.collocations(frame(spark, rows), 3)) == plain_version(rows, 3) and seeds == [1, 3]


def test_long_texts_and_long_words_are_split_alike(monkeypatch):
    raw = (b"ab cd. ef" * 50 + b" " + b"q" * 300 + b" gh," + b" i" + b"r" * 150 + b" es") * 20
    monkeypatch.setattr(phrases.hashing, "LONGEST", 200)
    whole = phrases.tokens(raw, 1)
    monkeypatch.setattr(phrases, "SEGMENT", 64)
    parts = phrases.tokens(raw, 1)
    assert all((a == b).all() for a, b in zip((whole[0], *whole[2:]), (parts[0], *parts[2:])))
    assert (np.diff(whole[1]) == 0).tolist() == (np.diff(parts[1]) == 0).tolist()
    words = [raw[s:e] for s, e in zip(*parts[2:])]
    assert words == re.findall(rb"[^ .,]+", raw) and len(set(zip(words, parts[0].tolist()))) == len(set(words)) == len({int(h) for h in parts[0]})


def test_products_beyond_64_bits(spark):
    big = 2**60
    f = spark.createDataFrame([([1, 2], big, None), ([1], big + 1, "en"), ([2], big, "en")], "words array<long>, n long, lang string")
    got = phrases._with_count(f.filter("size(words) = 2").selectExpr("words", "n AS a", "slice(words, 1, 1) AS head"), "head", f, f.limit(0), "l").collect()
    assert got[0]["l"] == big + 1
    r = spark.sql(f"SELECT (CAST(2000000 AS DECIMAL(7,0)) * CAST({big} AS DECIMAL(20,0))) div (CAST({big + 1} AS DECIMAL(20,0)) + CAST({big} AS DECIMAL(20,0))) AS s").first()["s"]
    assert r == 2000000 * big // (2 * big + 1)


def test_words_named_as_their_language_in_several_blocks(spark, monkeypatch):
    rows = [(lang, f"{lang} de en {'x' * 40} " * 30) for lang in ("en", "de", "es") for _ in range(4)]
    monkeypatch.setattr(phrases, "SEGMENT", 128)
    assert collected(phrases.collocations(frame(spark, rows), 3)) == plain_version(rows, 3)
    b = list(phrases.blocks([phrases.pa.record_batch({"lang": ["es", "es"], "text": [b"es en", b"en es"]})], 1))[0][0]
    assert b.hashes[0] == b.hashes[3] != b.hashes[1] == b.hashes[2]
