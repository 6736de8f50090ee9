"""Operator 6: benchmark decontamination with an Aho-Corasick automaton over words.

Every benchmark item becomes windows of ten consecutive words (one shorter
window for a shorter item). The distinct windows become one automaton whose
letters are words, built once per Python worker; each document is normalised
once and scanned once. Hits carry offsets of the original text.

A benchmark of more than ``max_windows`` windows is cut into as many automata as
that takes, by the hash of the window. Then the documents are scanned once with
each, and only documents with hits are shuffled to join what the scans found; no
worker ever holds more than one automaton.

Null and empty texts have no words and no hits. Items without a word have no
window, items without an id do not count. Repeated items each count under their
own id, repeated documents each have their row; a null document id is an id like
any other. Very long texts are scanned whole. Empty tables give no hits, or no
rows. Extra columns of either table are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import id_text_row, materialize, normalised, schema_of

#: Fixed value: a word of the original text, before A-Z are lowered.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPAN = "array<struct<start:int,end:int>>"
HITS = f"id long, n_words long, n_hit long, items array<string>, spans {SPAN}"


def item_windows(text: str | None, size: int) -> set[bytes]:
    """The item's windows as normalised words with single spaces."""
    words = normalised(text).split()
    last = max(len(words) - size, 0)
    return {b" ".join(words[i : i + size]) for i in range(last + 1)} if words else set()


def window_table(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(window, items): each distinct window once, with the ids of all its items."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, i) for i, t in zip(b["item"], b["text"]) for w in item_windows(t, size)]
            yield pd.DataFrame(rows, columns=["window", "item"])

    source = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    cut_up = source.where("item is not null").mapInPandas(cut, "window binary, item string")
    return cut_up.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


#: What stands for a word that no window has.
UNKNOWN = "\x01\x01"


def letters_of(number: int) -> str:
    """A word of the windows as two letters of different alphabets, so that no node of the automaton has many children."""
    return chr(0x200 + number // 256) + chr(0x100 + number % 256)


class Automaton:
    """Windows of words; a word is two letters, numbered within the automaton."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        self.items = [items for _, items in windows]
        self.machine = ahocorasick.Automaton()
        for at, (window, _) in enumerate(windows):
            words = window.split(b" ")
            for w in words:
                if w not in self.letters:
                    self.letters[w] = letters_of(len(self.letters))
            self.machine.add_word("".join(self.letters[w] for w in words), (at, len(words)))
        if windows:
            self.machine.make_automaton()

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, words, window) of every occurrence."""
        if not words or not self.items:
            return []
        known = self.letters
        text = "".join([known.get(w, UNKNOWN) for w in words])
        return [(end // 2 + 1 - n, n, at) for end, (at, n) in self.machine.iter(text)]


#: The automaton that this Python worker built last, with the name of the windows that it came from.
_built: list[tuple[str, Automaton]] = []


def automaton_of(sent: tuple) -> Automaton:
    """One automaton a worker: a worker that goes on with other windows drops the former one."""
    name, kept = sent
    if not _built or _built[0][0] != name:
        _built.clear()
        _built.append((name, Automaton(kept.value)))
    return _built[0][1]


def covered(starts: list[tuple[int, int]], n_words: int) -> np.ndarray:
    """Which words lie inside any (first word, words) run."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    for first, length in starts:
        edge[first] += 1
        edge[first + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def original_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Maximal runs of hit words as code-point offsets of the original text, end exclusive."""
    spans: list[dict] = []
    before = False
    for found, inside in zip(WORD.finditer(text), hit):
        if inside and before:
            spans[-1]["end"] = found.end()
        elif inside:
            spans.append({"start": found.start(), "end": found.end()})
        before = bool(inside)
    return spans


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    max_windows: int = 100_000,
    carry: bool = False,
) -> DataFrame:
    """Per document: ``id_col``, n_words, n_hit, items (ids whose windows occur) and spans of the original text.

    With ``carry`` the whole input row follows as the struct ``row``. An
    automaton holds ``max_windows`` windows, give or take what hashing spreads.
    """
    windows = materialize(window_table(items, item_col, item_text_col, window), "windows")
    source = id_text_row(docs, id_col, text_col, carry)
    parts = max(1, -(-windows.count() // max_windows))
    part = F.pmod(F.xxhash64("window"), F.lit(parts))
    shards = [windows.where(part == k) for k in range(parts)]
    hits = _in_one_scan(source, shards[0]) if parts == 1 else _in_many_scans(source, shards)
    return hits.withColumnRenamed("id", id_col)


def _sent(windows: DataFrame) -> tuple:
    """The windows of one automaton under a name of their own, as a broadcast of bounded size."""
    rows = [(bytes(r["window"]), r["items"]) for r in windows.toLocalIterator()]
    return uuid.uuid4().hex, windows.sparkSession.sparkContext.broadcast(rows)


def _in_one_scan(source: DataFrame, windows: DataFrame) -> DataFrame:
    kept = _sent(windows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(kept)
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = normalised(text.as_py()).split()
                found = automaton.find(words)
                names = sorted({x for at in {at for *_, at in found} for x in automaton.items[at]})
                rows.append(_described(i, text, len(words), [(first, n) for first, n, _ in found], names))
            yield _batch(rows, b.columns[2:])

    return source.mapInArrow(scan, schema_of(source, HITS))


def _in_many_scans(source: DataFrame, shards: list[DataFrame]) -> DataFrame:
    """The same from several automata: a scan with each, then one join of what they found."""
    texts = materialize(source.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text"), "texts")

    def scan_with(kept) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = automaton_of(kept)
            for b in batches:
                rows = []
                for i, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    found = automaton.find(normalised(text.as_py()).split())
                    if found:
                        names = sorted({x for at in {at for *_, at in found} for x in automaton.items[at]})
                        runs = sorted({(first, n) for first, n, _ in found})
                        rows.append((i, key, [{"first": first, "n_words": n} for first, n in runs], names))
                columns = list(zip(*rows)) or [()] * 4
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("n_words", pa.int32())])), pa.list_(pa.string())]
                names = ["id", "key", "found", "items"]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

        return texts.mapInArrow(scan, "id long, key long, found array<struct<first:int,n_words:int>>, items array<string>")

    # One scan after the other: a worker holds one automaton at a time.
    found = [materialize(scan_with(_sent(shard)), "hits") for shard in shards]
    every = reduce(DataFrame.unionAll, found).groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(
        F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text, found, names in zip(b.column("id").to_pylist(), b.column("text"), b.column("found").to_pylist(), b.column("items").to_pylist()):
                n = len(normalised(text.as_py()).split())
                rows.append(_described(i, text, n, [(x["first"], x["n_words"]) for x in found or []], sorted(names or [])))
            yield _batch(rows, [b.column("row")] if "row" in b.schema.names else [])

    keyed = source.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    return keyed.join(every, same, "left").mapInArrow(finish, schema_of(source, HITS))


def _described(i: int | None, text: pa.Scalar, n_words: int, runs: list[tuple[int, int]], names: list[str]) -> tuple:
    """One row of the result; the original text is read again only where something was hit."""
    if not runs:
        return i, n_words, 0, [], []
    hit = covered(runs, n_words)
    return i, n_words, int(hit.sum()), names, original_spans(text.as_py(), hit)


def _batch(rows: list[tuple], carried: list[pa.Array]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), span]
    columns = list(zip(*rows)) or [()] * 5
    names = ["id", "n_words", "n_hit", "items", "spans", "row"][: 5 + len(carried)]
    return pa.RecordBatch.from_arrays([*(pa.array(c, type=k) for c, k in zip(columns, kinds)), *carried], names=names)
