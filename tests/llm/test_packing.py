import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from tidewatch.llm import packing
from tidewatch.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, n string, salt string"


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from(" \n\t.,!'#éÜßàİ\x1ć<|endoftext|>"))))
def test_word_by_word_ids_equal_the_tokenizers(text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    assert np.frombuffer(packing.tokenizer(tokenizer_path())(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_a_text(whole):
    for text in ("a <|endoftext|> b", "x<|startoftext|>y", "don't we'll THE, the the", "a\x85b c d"):
        assert np.frombuffer(packing.tokenizer(tokenizer_path())(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_tightest_capacity():
    t, rng, have = packing.CapacityTree(37), np.random.RandomState(1), {}
    for _ in range(500):
        at = int(rng.randint(38))
        if have.get(at) and rng.rand() < 0.5:
            t.add(at, -1)
            have[at] -= 1
        else:
            t.add(at, 1)
            have[at] = have.get(at, 0) + 1
        least = int(rng.randint(38))
        assert t.tightest(least) == min((k for k, v in have.items() if v and k >= least), default=None)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60))
def test_plan_equals_best_fit_decreasing(lengths):
    hist = {n: lengths.count(n) for n in set(lengths)}
    room, used = {}, set()
    for n, steps in packing.plan(hist, 24).items():
        assert steps[:, 4].sum() == hist[n]
        for rank, first, each, offset, took in steps.tolist():
            for r in range(took):
                s, o = first + r // each, offset + r % each * n
                for at in range(o, o + n):
                    assert (s, at) not in used and at < 24
                    used.add((s, at))
                room[s] = room.get(s, 0) + n
    assert len(room) == brute.best_fit(lengths, 24)
    assert all((s, at) in used for s in room for at in range(room[s]))


def test_pack_rows(spark, whole):
    rows = [(1, "the cat sat"), (2, None), (3, ""), (4, "word " * 70), (5, "the cat sat"), (5, "the cat sat"), (None, "alone")]
    rows += [(10 + i, "copy of one text") for i in range(40)]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = packing.pack(df, tokenizer_path(), capacity=16).collect()
    expect = []
    for d, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 16):
            cut = np.array(ids[k:k + 16], dtype="<u4")
            expect.append((d, k // 16, k, len(cut), zlib.crc32(cut.tobytes())))
    order = lambda r: (r[0] or -1, *r[1:])
    assert sorted([tuple(r)[:5] for r in got], key=order) == sorted(expect, key=order)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 16
    assert len(by) == brute.best_fit([e[3] for e in expect], 16)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_path()).collect() == []
