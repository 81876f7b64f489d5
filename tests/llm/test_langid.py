import zlib

import numpy as np

from conftest import SF01
from tidewatch.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, score string, dim string, value string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


def test_cases(spark):
    rows = [(i, "the cat and the dog", "en", "a", "x", "y", "z") for i in range(30)]
    rows += [(100 + i, "der hund und die katze", "de", "a", "x", "y", "z") for i in range(30)]
    rows += [(200, None, "en", None, "x", "y", "z"), (201, "", None, "a", "x", "y", "z"), (202, "12 !? 3", "en", "a", "x", "y", "z"),
             (203, "und die der katze " * 20000, None, "a", "x", "y", "z"), (None, "the dog", None, "a", "x", "y", "z")]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i]["lang_pred"] for i in (200, 201, 202, 203, None, 0, 100)] == ["und", "und", "und", "de", "en", "en", "de"]
    assert got[200]["score"] == 0.0 and got[203]["score"] > 0.5


def test_empty_and_nothing_to_learn(spark):
    assert langid.identify(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, "some text", None, "a", "x", "y", "z")], SCHEMA)
    assert [r["lang_pred"] for r in langid.identify(one).collect()] == ["und"]


def test_bundle_is_the_sum_of_bound_trigrams():
    v = langid.letter_vectors()
    c = langid.letter_classes()
    b, some = langid.bundles(["Ab c", "", "9"])
    seq = [0, c[ord("a")], c[ord("b")], 0, c[ord("c")], 0]
    want = sum(np.roll(v[x], 2) * np.roll(v[y], 1) * v[z] for x, y, z in zip(seq, seq[1:], seq[2:]) if y)
    assert some.tolist() == [True, False, False] and np.array_equal(b[0], want) and not b[1:].any()
