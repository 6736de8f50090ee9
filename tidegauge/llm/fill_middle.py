"""Operator 11: fill-in-the-middle rearrangement by a sparse checkpoint index.

A text is cut at two line ends into prefix, middle and suffix and written with
sentinels as prefix-suffix-middle or suffix-prefix-middle. Cuts are drawn in
lines, texts are stored in UTF-8 bytes and lengths are asked in code points.
While the lines are counted, block by block, the byte and the code-point offset
of every ``every``-th line start are recorded. A cut looks up the checkpoint
before it by binary search and reads on from there, over fewer than ``every``
lines; no list of lines or of characters is made.

Every row is decided by its own text and id; nothing is shuffled. A null text
is empty, a null id draws like an empty one, repeated rows give repeated rows.
Empty texts, and texts that hold a sentinel themselves, stay plain. Very long
texts are cut whole. An empty table gives an empty result. Further columns of
any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import small_batches

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
NEWLINE = 10
BLOCK = 1 << 16
RESULT = "n_lines long, form string, start_byte long, end_byte long, prefix_chars long, middle_chars long, output string"


class Checkpoints(NamedTuple):
    """Offsets of the line starts number 0, every, 2 * every, ... and the number of lines."""

    every: int
    lines: int
    bytes: np.ndarray
    chars: np.ndarray


def leading(part: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (part & 0xC0) != 0x80


def checkpoints(data: bytes, every: int) -> Checkpoints:
    """One pass over the text in blocks; a checkpoint costs two numbers."""
    raw, ended, passed = np.frombuffer(data, dtype=np.uint8), 0, 0
    at, chars = [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)]
    for lo in range(0, len(raw), BLOCK):
        part = raw[lo : lo + BLOCK]
        ends, points = np.flatnonzero(part == NEWLINE), np.cumsum(leading(part))
        kept = ends[-(ended + 1) % every :: every]
        at.append(lo + kept + 1)
        chars.append(passed + points[kept])
        ended, passed = ended + len(ends), passed + int(points[-1])
    lines = ended + (len(data) > 0 and data[-1] != NEWLINE)
    return Checkpoints(every, lines, np.concatenate(at), np.concatenate(chars))


def locate(data: bytes, index: Checkpoints, line: int) -> tuple[int, int]:
    """(byte, code point) where line number ``line`` starts; the end of the text for the number of lines."""
    numbers = np.arange(len(index.bytes)) * index.every
    k = int(np.searchsorted(numbers, line, side="right")) - 1
    start = at = int(index.bytes[k])
    for _ in range(line - int(numbers[k])):
        found = data.find(b"\n", at)
        at = found + 1 if found >= 0 else len(data)
    rest = np.frombuffer(data, dtype=np.uint8, count=at - start, offset=start) if at > start else np.zeros(0, dtype=np.uint8)
    return at, int(index.chars[k]) + int(leading(rest).sum())


def drawn(digest: str) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers of a hexadecimal digest."""
    return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))


def rearranged(data: bytes, digest: str, every: int, fim: int, spm: int, marks: tuple[bytes, bytes, bytes]) -> tuple:
    """One row of ``RESULT``."""
    index, (first, second, turn, order) = checkpoints(data, every), drawn(digest)
    if not data or turn % 100 >= fim or any(m in data for m in marks):
        return index.lines, "plain", None, None, None, None, data
    low, high = sorted((first % (index.lines + 1), second % (index.lines + 1)))
    (start, before), (end, upto) = locate(data, index, low), locate(data, index, high)
    prefix, middle, suffix = data[:start], data[start:end], data[end:]
    p, s, m = marks
    if order % 100 < spm:
        form, output = "spm", b"".join((s, suffix, p, prefix, m, middle))
    else:
        form, output = "psm", b"".join((p, prefix, s, suffix, m, middle))
    return index.lines, form, start, end, before, upto - before, output


def fill_in_middle(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    fim_percent: int = 100,
    spm_percent: int = 50,
    seed: str = "7",
    every: int = 64,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """Per document: id_col, n_lines, form (plain, psm or spm), start_byte and end_byte of the middle, prefix_chars, middle_chars, output.

    Offsets and lengths are null for plain rows, whose output is the text. The
    draw is a hash of ``seed`` and the id, the same on every run.
    """
    if every < 1 or len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("checkpoints need a positive distance, sentinels three different texts")
    marks = tuple(m.encode() for m in sentinels)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))), 256)
    asked = small_batches(docs).select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("data"), digest.alias("digest"))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [rearranged(d.as_py(), h, every, fim_percent, spm_percent, marks) for d, h in zip(b.column(1), b.column(2).to_pylist())]
            columns = list(zip(*rows)) or [()] * len(kinds)
            columns[6] = pa.array(columns[6], pa.binary()).cast(pa.string())
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["id", *(f.split()[0] for f in RESULT.split(", "))])

    found = asked.mapInArrow(cut, f"id {docs.schema[id_col].dataType.simpleString()}, {RESULT}")
    return found.withColumnRenamed("id", id_col)


def restored(output: Column | str = "output", form: Column | str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text before the rearrangement, from output and form alone: plain texts as they are, others between their sentinels."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = sentinels

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, right, 1), left, -1)

    middle = F.substring_index(output, m, -1)
    whole = F.when(form == "psm", F.concat(between(p, s), middle, between(s, m)))
    return whole.when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)
