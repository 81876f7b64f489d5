"""Quality rules, line first: judge every line, remove the failures, then reject documents that
lost too much of their text.

A line (split at ``\\n``) fails when one of these rules holds; thresholds are parameters.

- punctuation: it has at least ``min_line_words`` words, and neither punctuation of sentences anywhere nor
  a closing bracket or quote at its end (lists, keyword dumps), nor is it a piece of a hard-wrapped sentence.
  Marks are those of any script, by their Unicode names; scripts without any are not judged by this rule. Lines with no
  blank line between them are pieces of one sentence where the first does not end it and the second goes on: it begins
  without a capital, or the first is as full as the paragraph's lines are. If one piece holds a mark, all are prose;
- shouting: most of its letters are capitals and most of its words end in ``!``;
- symbols: it holds more than ``max_symbols`` characters of ``[#*$%&|<>]`` for each word;
- navigation: more than ``max_separators`` of its words are bare separators (``|``, ``>`` ...);
- boilerplate: it holds a phrase of ``BOILERPLATE`` and is short;
- repetition: it is an exact copy of an earlier line of ``min_line_words`` words or more.

A document fails its base test when it has under 50 words or over half of its words lie in three-word
windows that occur twice; it is rejected when it fails that, or the removed lines hold more than
``max_lost`` of its words.

Cases: null text counts as empty (no words, base test failed); null ids and repeated rows are kept
as they are, a row out for each row in; extra columns are ignored; an empty table gives an empty
result with the same columns. One pass over the rows, no shuffle, memory bounded by one text.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidewatch.llm.common import map_columns, words

SYMBOLS = "#*$%&|<>"
# Phrases of page furniture, lower case.
BOILERPLATE = ("all rights reserved", "cookie policy", "accept cookies", "privacy policy", "terms of use",
               "terms of service", "enable javascript", "click here", "read more", "sign up", "log in",
               "subscribe to our newsletter", "share on facebook", "share on twitter", "lorem ipsum")

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_lines long, n_lines_removed long, n_words_removed long, "
          "cleaned string")

# Words in the Unicode names of what divides and what ends sentences; category Po alone would take in slashes and the like.
_DIVIDES = ("COMMA", "SEMICOLON", "COLON")
_STOPS = ("FULL STOP", "QUESTION MARK", "EXCLAMATION MARK", "ELLIPSIS", "DANDA", "KHAN", "SHAD")


def _named(parts: tuple[str, ...]) -> str:
    """Punctuation of any script whose name holds one of ``parts``."""
    po = (c for c in map(chr, range(0x20000)) if unicodedata.category(c) == "Po")
    return re.escape("".join(c for c in po if set(parts) & {p for p in parts if re.search(rf"\b{p}\b", unicodedata.name(c, ""))}))


_STOP = _named(_STOPS)
_SENTENCE = re.compile(rf"[{_STOP}{_named(_DIVIDES)}]|[)\]}}\"'”’»]\s*$")
_ENDS = re.compile(rf"[{_STOP}][)\]}}\"'”’»]*\s*$")
# Scripts written without marks between sentences (Thai, Lao, Tibetan, Myanmar, Khmer).
_UNMARKED = re.compile("[\u0e00-\u109f\u1780-\u17ff]")
_SEPARATOR = re.compile(rb"(?:[|>/<~=_*+-]|\xc2\xb7|\xe2\x80\xa2|\xc2\xbb|\xe2\x80\xba)+$")


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_pct: int = 50
    min_line_words: int = 8
    max_symbols: float = 0.5
    max_separators: float = 0.2
    max_caps: float = 0.7
    max_exclaimed: float = 0.5
    boilerplate_words: int = 25
    max_lost: float = 0.4


def repeated_words(ws: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(ws, ws[1:], ws[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def symbols(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def wrapped_prose(lines: list[str], counts: list[int], rules: Rules) -> set[int]:
    """Places of the lines that are pieces of a hard-wrapped sentence with a mark. ``counts``: words of each line."""
    out: set[int] = set()
    bare = [n >= rules.min_line_words and not _SENTENCE.search(line) for line, n in zip(lines, counts)]
    at = 0
    while at < len(lines):
        end = at
        while end < len(lines) and counts[end]:
            end += 1
        if any(bare[at:end]):
            out |= _wrapped(lines, counts, at, end)
        at = end + 1
    return out


def _wrapped(lines: list[str], counts: list[int], at: int, end: int) -> set[int]:
    """``wrapped_prose`` of one paragraph, the lines from ``at`` to ``end``."""
    sizes = {i: len(lines[i].strip(" \t\v\f\r")) for i in range(at, end)}
    first = {i: words(lines[i])[0].decode() for i in range(at, end)}
    width, most = max(sizes.values()), max(counts[at:end])
    # Full lines: the next word had no room, by characters or by words; one alone is no text column.
    full = {i for i in range(at, end - 1) if sizes[i] + 1 + len(first[i + 1]) > width or counts[i] == most}
    out, group = set(), [at]
    for i in range(at + 1, end + 1):
        if i < end and not _ENDS.search(lines[i - 1]):
            letter = next((c for c in first[i] if c.isalnum()), "")
            small = not (letter.isupper() or letter.istitle())
            if (small and 2 * sizes[i - 1] >= width) or (i - 1 in full and len(full) > 1):
                group.append(i)
                continue
        if len(group) > 1 and any(_SENTENCE.search(lines[j]) for j in group):
            out.update(group)
        group = [i]
    return out


def _unmarked(line: str) -> bool:
    """Whether most letters of a line are of a script without sentence marks."""
    hits = len(_UNMARKED.findall(line))
    return hits > 0 and 2 * hits > sum(c.isalpha() or _UNMARKED.match(c) is not None for c in line)


def line_fails(line: str, ws: list[bytes], rules: Rules, prose: bool = False) -> bool:
    """Whether a line with words fails one of the rules that look at the line alone; ``prose``: it is a piece of a
    hard-wrapped sentence, which needs no mark of its own."""
    n = len(ws)
    if symbols(line) > rules.max_symbols * n:
        return True
    if n >= 3 and sum(1 for w in ws if _SEPARATOR.match(w)) > rules.max_separators * n:
        return True
    if n >= rules.min_line_words and not prose and not _SENTENCE.search(line) and not _unmarked(line):
        return True
    if "!" in line and sum(1 for w in ws if w.endswith(b"!")) > rules.max_exclaimed * n:
        letters = [c for c in line if c.isalpha()]
        if n >= 3 and sum(map(str.isupper, letters)) > rules.max_caps * len(letters):
            return True
    if n <= rules.boilerplate_words:
        low = line.lower()
        return any(p in low for p in BOILERPLATE)
    return False


def judge(text: str | None, rules: Rules = Rules()) -> dict:
    """Counts, verdict and cleaned text of one text."""
    text = text or ""
    ws = words(text)
    n = len(ws)
    kept, seen = [], set()
    dup = removed = lost = lines = 0
    split = text.split("\n")
    line_words = [words(line) for line in split]
    prose = wrapped_prose(split, [len(lw) for lw in line_words], rules)
    for i, (line, lw) in enumerate(zip(split, line_words)):
        if not lw:
            kept.append(line)
            continue
        lines += 1
        again = line in seen
        seen.add(line)
        dup += again
        if (again and len(lw) >= rules.min_line_words) or line_fails(line, lw, rules, i in prose):
            removed += 1
            lost += len(lw)
        else:
            kept.append(line)
    rep = repeated_words(ws)
    base = n < rules.min_words or 100 * rep > rules.max_repeat_pct * n
    return {"n_words": n, "word_chars": len(text) - sum(map(text.count, " \t\n\v\f\r")), "n_symbols": symbols(text),
            "n_dup_lines": dup, "n_repeat_words": rep, "base_failed": base,
            "kept": not base and lost <= rules.max_lost * n, "n_lines": lines, "n_lines_removed": removed,
            "n_words_removed": lost, "cleaned": text if not removed else "\n".join(kept)}


def quality(docs: DataFrame, rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """One row for each document: counts, verdict and (``with_text``) the text without failed lines."""
    schema = SCHEMA if with_text else SCHEMA.rsplit(",", 1)[0]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = [judge(t, rules) for t in b["text"]]
            yield {"doc_id": b["doc_id"]} | {k: [r[k] for r in rows] for k in names[1:]}

    return map_columns(docs.select("doc_id", "text"), run, schema)


def passing(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, in their own columns; ``text`` and ``n_chars`` without the failed lines."""
    cols = docs.columns

    def run(batches):
        for b in batches:
            out = {c: [] for c in cols}
            for i, t in enumerate(b["text"]):
                got = judge(t, rules)
                if got["kept"]:
                    for c in cols:
                        out[c].append(b[c][i])
                    if got["n_lines_removed"]:
                        out["text"][-1] = got["cleaned"]
                        if "n_chars" in out:
                            out["n_chars"][-1] = len(got["cleaned"])
            if out["text"]:
                yield out

    return map_columns(docs, run, docs.schema)
