"""Fill-in-the-middle: a text is cut into prefix, middle and suffix and written in the order a model learns from.

A text is a row of units (code points by default; any pattern may be given). One ``fullmatch`` of ``(unit)*`` by the
``regex`` library keeps every repetition of the group, so ``ends(1)`` holds the end of each unit: its length is n,
and the offset after k units is its entry k - 1. Both cuts are read from it, no unit is visited in Python.
The list takes some 130 bytes a unit, so a text of more than ``BLOCK`` units is matched block by block, each from the
end of the one before; that is the same row of units, in bounded memory beyond the text itself.

The draw of a document comes from its id and the seed alone (four 32-bit parts of a SHA-256), so a replayed task writes
the same output. ``prefix``, ``middle`` and ``suffix`` do not depend on the form.

Forms, with marks ``<P> <S> <M>``: plain, the text as it is; psm, ``<P>prefix<S>suffix<M>middle``;
spm, ``<S>suffix<P>prefix<M>middle``. A text that holds a mark stays plain. A mark begins with ``<``, ends with ``>`` and holds
neither inside, so none can arise where text and mark meet: ``restored`` splits an output at its marks in JVM functions, and finds the exact text.

Cases: null text is empty; an empty text is plain with n 0; a null id is drawn as the empty word; repeated rows are drawn alike;
a text that units do not fill is plain with n null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_columns, prepare

MARKS = ("<P>", "<S>", "<M>")
CODE_POINT = r"(?s:.)"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
#: Units matched at once: some 35 MB of captures.
BLOCK = 1 << 18


class Units:
    """The units of a text: how many there are, and the offset after k of them."""

    def __init__(self, unit: str = CODE_POINT, block: int = BLOCK):
        import regex
        self.block = block
        self.whole = regex.compile(f"({unit})*")
        self.part = regex.compile(f"({unit}){{1,{block}}}")

    def cut(self, text: str, h1: int, h2: int) -> tuple[int, int, int] | None:
        """n and the offsets of both cuts, after ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units, the smaller first;
        None where units do not fill the text."""
        if len(text) > self.block:  # a unit has one character at least
            return self._cut_by_blocks(text, h1, h2)
        m = self.whole.fullmatch(text)
        if not m:
            return None
        ends = m.ends(1)
        n = len(ends)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        return n, ends[a - 1] if a else 0, ends[b - 1] if b else 0

    def _cut_by_blocks(self, text: str, h1: int, h2: int) -> tuple[int, int, int] | None:
        starts, n, at = [], 0, 0
        while at < len(text):
            m = self.part.match(text, at)
            if not m or m.end() == at:
                return None
            starts.append(at)
            n += len(m.ends(1))
            at = m.end()

        def offset(k: int) -> int:  # only the last block may hold fewer units
            return self.part.match(text, starts[(k - 1) // self.block]).ends(1)[(k - 1) % self.block] if k else 0

        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        return n, offset(a), offset(b)


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def transform(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, unit: str = CODE_POINT,
              marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of each document (lengths in code points, null where plain)."""
    prepare(docs.sparkSession)
    if len(set(marks)) != 3 or not all(re.fullmatch(r"<[^<>]+>", m) for m in marks):
        raise ValueError("marks must be three different names in angle brackets")
    p, s, m = marks

    def run(batches):
        units = Units(unit)
        for b in batches:
            out = {k: [] for k in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")}
            for doc_id, text in zip(b["doc_id"], b["text"]):
                text = text or ""
                h1, h2, h3, h4 = draws(seed, doc_id)
                at = units.cut(text, h1, h2)
                form, prefix, middle, output = "plain", None, None, text
                if text and at and h3 % 100 < fim_percent and not any(x in text for x in marks):
                    _, i, j = at
                    prefix, middle = i, j - i
                    if h4 % 100 < spm_percent:
                        form, output = "spm", f"{s}{text[j:]}{p}{text[:i]}{m}{text[i:j]}"
                    else:
                        form, output = "psm", f"{p}{text[:i]}{s}{text[j:]}{m}{text[i:j]}"
                for k, v in zip(out, (doc_id, at[0] if at else None, form, prefix, middle, output)):
                    out[k].append(v)
            yield out

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def restored(output: str | Column = "output", form: str | Column = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text rebuilt from an output and its form."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))


def digests(fim: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars`` and the digests of the output and of the text rebuilt from it."""
    return fim.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(), 256).alias("restored_sha256"))


def fim_sql(seed: int = 1) -> str:
    """DuckDB SQL of ``digests(transform(documents))``."""
    return rf"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM documents),
numbers AS (
  SELECT doc_id, text, n, CAST('0x' || d[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || d[9:16] AS BIGINT) % (n + 1) AS c2,
         CAST('0x' || d[17:24] AS BIGINT) % 100 AS p3, CAST('0x' || d[25:32] AS BIGINT) % 100 AS p4
  FROM drawn),
cuts AS (
  SELECT doc_id, text, n, least(c1, c2) AS i, greatest(c1, c2) AS j,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR p3 >= 90 THEN 'plain'
              WHEN p4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
pieces AS (
  SELECT *, substring(text, 1, i) AS pre, substring(text, i + 1, j - i) AS mid, substring(text, j + 1, n - j) AS suf FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(i AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(j - i AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
       sha256(pre || mid || suf) AS restored_sha256
FROM pieces"""
