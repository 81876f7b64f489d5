"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1 (``DIM`` components, from a hash seed). A letter trigram
within a word is bound by multiplying its letters' vectors, the first rotated twice, the second once, the third not
at all; a word's edges count as a letter of their own. A text's vector is the bundle (sum) of its trigram vectors; a language's
prototype is the bundle of its learning documents. A text gets the language whose prototype has the largest cosine
with it, and that cosine (from 0) as its score; equal cosines go to the smaller name.

Bundling is linear, so a text's vector is its trigram counts times the trigram vectors: one matrix product for a batch of
texts over the trigrams that occur in it.

Learning reads every row that the fold rule allows: text, language and fold alone, never source or id as a feature. Tasks bundle
per language; a language's partial sums are ``DIM`` numbers a task, summed by Spark per (language, component). The prototypes, languages x
``DIM`` numbers, come to the driver and go to the tasks inside the function; more than ``MAX_LANGUAGES`` are refused.

Letters: lower case of the composed text; each letter beyond a to z falls into one of 101 classes by its code point; whatever is not a
letter ends a word.

Cases: null text or none of its characters a letter: ``und`` with score 0; a null language does not teach; an id that is
null counts as the text ``null`` in the fold rule and is held out by it like others; with no learning row
all are ``und``; repeated rows are rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_columns, prepare

DIM, SEED, FOLDS = 1024, 20_11, 5
CLASSES, MAX_LANGUAGES = 128, 2000
#: Characters that are counted and multiplied at once.
CHUNK = 1_000_000
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """Class of every code point: 0 no letter, 1 to 26 a to z, else 27 to 127."""
    out = np.zeros(0x110000, dtype=np.uint8)
    out[[i for i in range(0x110000) if chr(i).isalpha()]] = 255
    others = np.flatnonzero(out)
    out[others] = 27 + (others * 2654435761 >> 7) % 101
    out[ord("a"):ord("z") + 1] = np.arange(1, 27)
    return out


@lru_cache(maxsize=1)
def letter_vectors() -> np.ndarray:
    """A random vector of +1 and -1 for each class."""
    return np.random.RandomState(SEED).choice(np.array([-1, 1], dtype=np.float32), size=(CLASSES, DIM))


def trigrams(text: str | None) -> np.ndarray:
    """Codes of the trigrams of a text's words, edges included."""
    if not text:
        return np.zeros(0, dtype=np.int32)
    low = unicodedata.normalize("NFC", text.lower())
    c = letter_classes()[np.frombuffer(low.encode("utf-32-le"), dtype=np.uint32)].astype(np.int32)
    c = np.concatenate([np.zeros(1, np.int32), c, np.zeros(1, np.int32)])
    keep = (c[1:] > 0) | (c[:-1] > 0)  # one edge between words
    c = np.concatenate([c[:1], c[1:][keep]])
    code = (c[:-2] << 14) | (c[1:-1] << 7) | c[2:]
    return code[c[1:-1] > 0]


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    v = letter_vectors()
    return np.roll(v, 2, axis=1)[codes >> 14] * np.roll(v, 1, axis=1)[(codes >> 7) & 127] * v[codes & 127]


def bundles(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text, and whether it has a letter."""
    grams = [trigrams(t) for t in texts]
    some = np.array([len(g) > 0 for g in grams], dtype=bool)
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    if not some.any():
        return out, some
    codes, place = np.unique(np.concatenate(grams), return_inverse=True)
    row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    # The matrix of counts has one cell for each text and trigram of the batch; texts go in groups of bounded size.
    vectors = gram_vectors(codes)
    step = max(1, 4_000_000 // len(codes))
    ends = np.cumsum([0] + [len(g) for g in grams])
    for at in range(0, len(texts), step):
        to = min(len(texts), at + step)
        cells = (row[ends[at]:ends[to]] - at) * len(codes) + place[ends[at]:ends[to]]
        counts = np.bincount(cells, minlength=(to - at) * len(codes)).reshape(to - at, len(codes))
        out[at:to] = counts.astype(np.float32) @ vectors
    return out, some


def _chunks(*columns: list):
    """The rows of a batch in groups of about ``CHUNK`` characters; the first column is the text."""
    at, size = 0, 0
    for i, t in enumerate(columns[0]):
        size += len(t or "")
        if size >= CHUNK or i == len(columns[0]) - 1:
            yield [c[at:i + 1] for c in columns]
            at, size = i + 1, 0


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % FOLDS == 0


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes from the rows that are not held out."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for texts, langs in _chunks(b["text"], b["lang"]):
                v, _ = bundles(texts)
                langs = np.array(langs, dtype=object)
                for one in sorted(set(langs)):
                    got = v[langs == one].sum(axis=0, dtype=np.float64)
                    sums[one] = sums[one] + got if one in sums else got
        for one, s in sums.items():
            yield {"lang": [one] * DIM, "dim": list(range(DIM)), "value": s.astype(np.int64).tolist()}

    parts = map_columns(rows, run, "lang string, dim int, value long")
    sums = parts.groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    # languages x DIM numbers.
    got = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    got.sort(key=lambda r: r["lang"])
    table = np.array([[x["value"] for x in r["v"]] for r in got], dtype=np.float64).reshape(len(got), DIM)
    return [r["lang"] for r in got], table


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row."""
    prepare(docs.sparkSession)
    langs, table = learn(docs)
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    unit = (table / np.where(norms > 0, norms, 1)).astype(np.float32)

    def run(batches):
        for b in batches:
            for texts, ids, held in _chunks(b["text"], b["doc_id"], b["held_out"]):
                v, some = bundles(texts)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                cos = (v / np.where(size > 0, size, 1)) @ unit.T if langs else np.zeros((len(texts), 1), np.float32)
                best = cos.argmax(axis=1)
                ok = some & bool(langs)
                score = np.clip(cos[np.arange(len(texts)), best].astype(float), 0, 1)
                yield {"doc_id": ids, "held_out": held,
                       "lang_pred": [langs[k] if o else "und" for k, o in zip(best, ok)],
                       "score": np.where(ok, score, 0.0).tolist()}

    return map_columns(docs.select("text", "doc_id", held_out(F.col("doc_id")).alias("held_out")), run, SCHEMA)
