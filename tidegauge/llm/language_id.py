"""Operator 9: language identification of mixed-language text.

Training counts hashed letter trigrams and writing scripts per language over
all labelled rows. To predict, every word gets a log-likelihood per language;
script ranges leave only the languages that use the script of most of the word's
letters (all languages, if none uses it); a Viterbi pass with a switching
penalty labels the words, and runs of one label are the spans. The document's
language is the one with most letters. Marks (vowel signs, accents) belong to
the word that they stand in, but are no letters by themselves.

The model is ``BUCKETS`` numbers a language, whatever the corpus. A null text
and a text without a letter give ``und`` with score 0 and no span. Very long
texts are labelled whole. Ties go to the language that sorts first. Repeated
rows are each labelled. Without any labelled row every text gives ``und``. An
empty table gives an empty result; a null id stays null; extra columns are
ignored, or carried in one struct.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import id_text_row, schema_of, small_batches

BUCKETS = 1 << 16
POINTS = 0x110000
#: First and last code point of writing scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF), (0x30000, 0x3FFFF)],
}
N_SCRIPTS = len(SCRIPTS) + 1
#: Words of all texts that advance together, padding included: bounds the memory of a pass.
WORDS_AT_ONCE = 300_000
#: Below any sum of scores: a word never gets a language that does not write its script.
EXCLUDED = -1e6
SPANS = "array<struct<start:int,end:int,lang:string>>"


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: the lower-case letter or mark (0: neither), its script, and whether it is a letter."""
    lower, script = np.zeros(POINTS, dtype=np.uint32), np.zeros(POINTS, dtype=np.uint8)
    letter = np.zeros(POINTS, dtype=bool)
    for c in range(POINTS):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            low = chr(c).lower()
            lower[c], letter[c] = ord(low) if len(low) == 1 else c, True
        elif kind == "M":
            lower[c] = c
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            script[first : last + 1] = k
    return lower, script, letter


@dataclass
class Letters:
    """The letters of a text: their places, trigram buckets and scripts, and where words start among them."""

    at: np.ndarray
    bucket: np.ndarray
    script: np.ndarray
    words: np.ndarray


def letters(text: str) -> Letters:
    lower, script, letter = tables()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    low = np.zeros(len(points) + 2, dtype=np.uint32)
    if letter[points].any():
        low[1:-1] = lower[points]
    at = np.flatnonzero(low[1:-1])
    mixed = low[at] * np.uint32(0x9E3779B1) ^ low[at + 1] * np.uint32(0x85EBCA77) ^ low[at + 2] * np.uint32(0xC2B2AE3D)
    bucket = (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    starts = np.flatnonzero(low[at] == 0)
    return Letters(at, bucket, script[points[at]], starts)


def word_scripts(found: Letters) -> np.ndarray:
    """The script of most letters of each word; of equals the first in the list of scripts."""
    first = np.minimum.reduceat(found.script, found.words)
    last = np.maximum.reduceat(found.script, found.words)
    ends = np.append(found.words[1:], len(found.script))
    for k in np.flatnonzero(first != last):
        counts = np.bincount(found.script[found.words[k] : ends[k]], minlength=N_SCRIPTS)
        first[k] = 1 + counts[1:].argmax()  # marks of no script do not count
    return first


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_languages: int = 256) -> dict:
    """{lang: (trigram counts, script counts)} over all rows with a text and a label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS + N_SCRIPTS, dtype=np.int64))
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = letters(text.as_py())
                values, n = np.unique(found.bucket, return_counts=True)
                totals[lang][values] += n
                totals[lang][BUCKETS:] += np.bincount(found.script, minlength=N_SCRIPTS)
        for lang, row in totals.items():
            keys = np.flatnonzero(row)
            columns = [pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int32()), pa.array(row[keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    small_batches(labelled)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(r[0] for r in rows.select("lang").distinct().limit(max_languages + 1).collect())
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages, and the driver's memory with it")
    model = {name: np.zeros(BUCKETS + N_SCRIPTS, dtype=np.int64) for name in names}
    found = counted.toPandas()
    for name, part in found.groupby("lang"):
        model[name][part["bucket"].to_numpy()] = part["n"].to_numpy()
    return {k: (v[:BUCKETS], v[BUCKETS:]) for k, v in model.items()}


@dataclass
class Model:
    names: list[str]
    scores: np.ndarray  # bucket x language
    scripts: np.ndarray  # script x language: 0, or EXCLUDED where the language does not use the script


def fitted(counts: dict, *, smoothing: float = 0.5, script_share: float = 0.01) -> Model:
    names = sorted(counts)
    grams = np.stack([counts[k][0] for k in names], axis=1) + smoothing if names else np.zeros((BUCKETS, 0))
    scripts = np.stack([counts[k][1] for k in names], axis=1) if names else np.zeros((N_SCRIPTS, 0))
    uses = scripts >= script_share * np.maximum(scripts.sum(axis=0), 1)
    penalty = np.where(uses | ~uses.any(axis=1, keepdims=True), 0.0, EXCLUDED)
    return Model(names, np.log(grams / grams.sum(axis=0)).astype(np.float32), penalty.astype(np.float32))


def word_scores(model: Model, found: Letters) -> np.ndarray:
    """Words x languages: log-likelihood of each word's trigrams; no path takes a language without the word's script."""
    by_word = np.add.reduceat(model.scores[found.bucket], found.words, axis=0)
    return by_word + model.scripts[word_scripts(found)]


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Best label of every word of every text. Texts advance together, longest first, so a step is one array operation."""
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(scores)
    at = 0
    while at < len(order) and len(scores[order[at]]):
        part = order[at : at + max(1, WORDS_AT_ONCE // len(scores[order[at]]))]
        at += len(part)
        sizes = np.array([len(scores[k]) for k in part])
        longest, n = int(sizes[0]), scores[part[0]].shape[1]
        cube = np.zeros((longest, len(part), n), dtype=np.float32)
        for j, k in enumerate(part):
            cube[: sizes[j], j] = scores[k]
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")
        back = np.zeros((longest, len(part)), dtype=np.int16)  # the label to switch from
        stay = np.zeros((longest, len(part), n), dtype=bool)
        state = cube[0].copy()
        for t in range(1, longest):
            a = active[t]
            now = state[:a]
            best = now.argmax(axis=1)
            top = now.max(axis=1, keepdims=True) - switch
            keep = now >= top
            back[t, :a], stay[t, :a] = best, keep
            state[:a] = np.where(keep, now, top) + cube[t, :a]
        label = state.argmax(axis=1)
        labels = np.zeros((longest, len(part)), dtype=np.int16)
        rows = np.arange(len(part))
        for t in range(longest - 1, -1, -1):
            a = active[t]
            labels[t, :a] = label[:a]
            if t:
                label[:a] = np.where(stay[t, rows[:a], label[:a]], label[:a], back[t, :a])
        for j, k in enumerate(part):
            out[k] = labels[: sizes[j], j]
    return out


def describe(model: Model, found: Letters, labels: np.ndarray) -> tuple[str, float, list[dict]]:
    """The document's language, its share of the letters, and the spans."""
    ends = np.append(found.words[1:], len(found.at))
    share = np.bincount(labels, weights=ends - found.words, minlength=len(model.names))
    best = int(share.argmax())
    first = np.flatnonzero(np.append(True, labels[1:] != labels[:-1]))
    last = np.append(first[1:], len(labels)) - 1
    spans = [
        {"start": int(found.at[found.words[a]]), "end": int(found.at[ends[b] - 1]) + 1, "lang": model.names[labels[a]]}
        for a, b in zip(first, last)
    ]
    return model.names[best], float(share[best] / share.sum()), spans


def identify(
    docs: DataFrame, counts: dict, *, id_col: str = "doc_id", text_col: str = "text", switch: float = 12.0, carry: bool = False
) -> DataFrame:
    """Per document: id_col, lang_pred, score (share of the letters in that language) and spans of the original text.

    With ``carry`` the whole input row follows as the struct ``row``.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(counts))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                found = [letters(t.as_py() or "") for t in b.column(1)]
                some = [k for k, x in enumerate(found) if len(x.at) and known.names]
                labels = viterbi([word_scores(known, found[k]) for k in some], switch)
                rows: list[tuple] = [("und", 0.0, [])] * b.num_rows
                for k, path in zip(some, labels):
                    rows[k] = describe(known, found[k], path)
                names, score, spans = zip(*rows) if rows else ((), (), ())
                columns = [b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)]
                names = ["id", "lang_pred", "score", "spans", "row"][: 2 + b.num_columns]
                yield pa.RecordBatch.from_arrays([*columns, *b.columns[2:]], names=names)

    source = id_text_row(docs, id_col, text_col, carry)
    out = source.mapInArrow(label, schema_of(source, f"id long, lang_pred string, score double, spans {SPANS}"))
    return out.withColumnRenamed("id", id_col)
