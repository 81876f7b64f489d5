import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from tidewatch.llm import hashing


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\t\n\x0b\x1c\xa0", max_size=60))
def test_equal_words_alone(text):
    ws = brute.word_list(text)
    h = hashing.word_hashes(text).tolist()
    assert len(h) == len(ws) and [hashing.word_hashes(w)[0] for w in ws] == h
    assert len(set(h)) == len(set(ws))


def test_long_texts_and_words():
    words = [f"w{i * 7919 % 40000}" for i in range(60_000)] + ["x" * (hashing.CHUNK * 2), "y" * (hashing.LONGEST + 5), "z"]
    h = hashing.word_hashes("  ".join(words))
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    assert h[100] == hashing.word_hashes(words[100])[0] and h[-1] == hashing.word_hashes("z")[0]
    assert h[-3] == hashing.word_hashes(words[-3])[0]
    # Words of a chunk that a very long word ends.
    assert h[59_999] == hashing.word_hashes(words[59_999])[0] and hashing.word_hashes("a b " + "y" * (hashing.LONGEST + 5))[1] == hashing.word_hashes("b")[0]
    assert hashing.word_hashes(None).dtype == np.uint64 and len(hashing.word_hashes(" \n ")) == 0


def test_anagrams_and_prefixes_differ():
    import itertools
    words = ["".join(p) for n in range(1, 7) for p in itertools.product("abc", repeat=n)]
    assert len(set(hashing.word_hashes(" ".join(words)).tolist())) == len(words)
