import re
import textwrap
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from conftest import SF01
from tidewatch.llm import quality


def counts(text):
    ws = brute.word_list(text)
    win = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    often = Counter(win)
    hit = {j for i, w in enumerate(win) if often[w] > 1 for j in range(i, i + 3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if brute.word_list(line):
            dup += line in lines
            lines.add(line)
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit),
            len(ws) < 50 or 100 * len(hit) > 50 * len(ws))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b#|\x1c é", max_size=200))
def test_counts_against_brute_force(text):
    r = quality.judge(text)
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == counts(text)


def prose(n):
    return " ".join(f"word{n}x{i}" + ("," if i % 9 == 8 else "") for i in range(n)) + "."


def test_lines():
    clean = "\n".join(prose(30 + i) for i in range(5))
    assert quality.judge(clean)["kept"] and quality.judge(clean)["cleaned"] == clean
    nav = "Home | News | About | Contact"
    shout = "BUY!! NOW!! CHEAP!! THINGS!!"
    symbols = "so### many$$$ signs%%% here&&&"
    dump = "one two three four five six seven eight nine"
    for bad in (nav, shout, symbols, dump, "We use cookies. See our privacy policy."):
        r = quality.judge(clean + "\n" + bad)
        assert r["kept"] and r["cleaned"] == clean and r["n_lines_removed"] == 1, bad
    lost = quality.judge(prose(60) + "\n" + "\n".join(" | ".join(f"k{j}x{i}" for i in range(40)) for j in range(3)))
    assert not lost["base_failed"] and not lost["kept"]
    again = quality.judge(clean + "\n" + prose(30))
    assert again["n_lines_removed"] == 1 and again["cleaned"] == clean


def test_hard_wrapped_prose_is_whole():
    words = " ".join(f"Start{i} " + " ".join(f"{'Name' if j % 6 == 5 else 'word'}{i}x{j}" for j in range(26)) + "." for i in range(12)).split()
    by_words = [" ".join(words[i:i + 9]) for i in range(0, len(words), 9)]
    by_width = textwrap.wrap(" ".join(words), 72)
    for lines in (by_words, by_width):
        text = "\n".join(lines)
        assert any(not quality._SENTENCE.search(x) and len(x.split()) >= 8 for x in lines)
        r = quality.judge(text)
        assert r["kept"] and r["cleaned"] == text
    dump = "cheap shoes best price free parcel online shop now"
    r = quality.judge("\n".join(by_width) + "\n\n" + dump + "\n\n" + "\n".join(by_width[:3]))
    assert dump not in r["cleaned"]
    assert quality.judge(prose(60) + "\n" + dump + "\n" + "Other" + prose(61))["n_lines_removed"] == 1
    thai = "\u0e01\u0e32\u0e23 " * 9
    for line in ("एक दो तीन चार पाँच छह सात आठ नौ।", "واحد اثنان ثلاثة، أربعة خمسة ستة سبعة ثمانية", thai.strip()):
        assert not quality.line_fails(line, line.encode().split(), quality.Rules()), line


def test_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality(docs).join(labels, "doc_id").collect()
    good = [r for r in got if r["quality"] == 1 and not r["base_failed"]]
    poor = [r for r in got if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good) and sum(r["kept"] for r in poor) <= 0.02 * len(poor)


def test_rows(spark):
    schema = "doc_id long, text string, n_chars int, kept string, n_words string"
    text = "\n".join(prose(40 + i) for i in range(3))
    rows = [(1, text, 5, "a", "b"), (1, text, 5, "a", "b"), (2, None, None, "a", "b"), (None, "", 0, "a", "b"),
            (3, text + "\nHome | News | About", 7, "a", "b"), (4, "x " * 200_000, 1, "a", "b")]
    df = spark.createDataFrame(rows, schema)
    assert sorted((r["doc_id"] or 0, r["kept"], r["n_words"]) for r in quality.quality(df).collect()) == [
        (0, False, 0), (1, True, 123), (1, True, 123), (2, False, 0), (3, True, 128), (4, False, 200_000)]
    kept = quality.passing(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"] == text, r["n_chars"], r["kept"]) for r in kept.collect()) == [
        (1, True, 5, "a"), (1, True, 5, "a"), (3, True, len(text), "a")]
    empty = spark.createDataFrame([], schema)
    assert quality.quality(empty).collect() == [] and quality.passing(empty).collect() == []


SPACES = "\u00a0\u3000\u2028\u2029\u0085\u1680\u2003\u202f\u205f\x1c\x1d\x1e\x1f"


@pytest.mark.parametrize("space", SPACES)
def test_lines_of_other_white_space(space):
    bare = "one two three four five six seven eight nine ten"
    for text in (f"{bare}\n{space}\n{bare}", f"{space}\n{bare}\n{space}", f"{bare}{space}\n{space}{bare}\n{space} {space}", space, f"{bare}\n{space}\r"):
        got = quality.judge(text)
        assert got["n_words"] == len(brute.word_list(text)) and got["n_lines"] >= 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab. ,A" + SPACES, max_size=60), max_size=8))
def test_random_lines_never_fail(lines):
    text = "\n".join(line if i % 2 else "some line of words without a mark and so on " + line for i, line in enumerate(lines))
    got = quality.judge(text)
    assert got["n_words"] == len(brute.word_list(text))


def test_a_very_long_text_and_line():
    text = "word " * 300_000 + "\n" + ("a line of eight words or more without mark\n" * 5_000)
    assert quality.judge(text)["n_words"] == 300_000 + 9 * 5_000
