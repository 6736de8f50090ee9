"""Operator 10: sequence packing by non-negative least squares over length combinations.

1. Each document is tokenized once, where Spark has it, and cut into windows of
   ``window`` ids; only the last piece of a document is shorter. A row per
   piece, without its ids, goes to the shared folder.
2. The histogram of short pieces reaches the driver: a bin for each length
   under ``exact``, then one for each ``step`` ids. Combinations of up to three
   multiples of ``step`` that fill a window are enumerated, non-negative least
   squares gives each a repeat count, counts are rounded down, and what remains
   is packed greedily, largest first, bin by bin, by room in ids.
   All of this works on counts, so it does not grow with the rows.
3. Pieces get their sequence from their rank inside their bin. Ranks come from
   counts of (bin, salt) groups, so no bin is ever sorted in one task.

A null text counts as empty and yields one piece: the closing id alone. Ties
and repeated rows are packed one by one. An empty table gives an empty result.
Very long texts are tokenized whole, as one piece of memory in a task; runs of
white space of any length are allowed. A null id stays null. Extra columns are
ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import id_text_row, materialize

PIECE = "id long, start long, length long, ids_crc32 long, doc_tokens long"
#: White space from which the fast library's cut into words may run out of stack.
LONG_SPACE = re.compile(r"\s{2000}")
#: Fixed value: the cut into words that belongs to this family of byte-level vocabularies.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary file writes each byte: itself if printable, else the next one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them for a byte-level BPE file.

    The file's vocabulary drives tiktoken, whose merges by rank are the same
    and run several times as fast; the tests hold both libraries' ids equal.
    Texts with very long white space go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, added = byte_letters(), {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        if any(x.get(k) for x in file.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        vocabulary = {t: i for t, i in file["model"]["vocab"].items() if t not in added}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
        self.model = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=added)
        self.slow = Tokenizer.from_file(path)

    def encode(self, text: str) -> np.ndarray:
        """Ids of text as such: the name of an added token is text, too."""
        return np.asarray(self.model.encode_ordinary(text), dtype="<u4")

    def encode_added(self, text: str) -> np.ndarray:
        """Ids with one id for each added token of the file, as the tokenizers library gives them by default."""
        if len(text) >= 2000 and LONG_SPACE.search(text):
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.model.encode(text, allowed_special="all"), dtype="<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, *, id_col: str, text_col: str, window: int, end_id: int) -> DataFrame:
    """One row per piece: id, start, length, crc32 of its ids, and the document's ids with the closing one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_added
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.asarray([end_id], dtype="<u4"))
                for s in range(0, len(ids), window):
                    part = ids[s : s + window]
                    rows.append((i, s, len(part), zlib.crc32(part.tobytes()), len(ids)))
            columns = list(zip(*rows)) or [()] * 5
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names)

    return id_text_row(docs, id_col, text_col, carry=False).mapInArrow(cut, PIECE)


def combinations(bins: int) -> np.ndarray:
    """All multisets of one to three bins (1-based; 0: none) that sum to exactly ``bins``."""
    a, b = np.meshgrid(np.arange(bins + 1), np.arange(bins + 1), indexing="ij")
    c = bins - a - b
    keep = (a <= b) & (b <= c)
    return np.stack([a[keep], b[keep], c[keep]], axis=1)


def non_negative_fit(columns: np.ndarray, counts: np.ndarray, rounds: int) -> np.ndarray:
    """Active-set least squares: repeat counts >= 0 of sparse 0..3-entry columns that best add up to ``counts``."""
    n, bins = len(columns), len(counts)
    used: list[int] = []
    x = np.zeros(0)

    def matrix(of: list[int]) -> np.ndarray:
        m = np.zeros((bins, len(of)))
        for k in range(3):
            np.add.at(m, (columns[of, k], np.arange(len(of))), 1.0)
        m[0] = 0
        return m

    rest = counts.astype(float).copy()
    rest[0] = 0
    chosen = np.zeros(n, dtype=bool)
    for _ in range(rounds):
        gain = rest[columns].sum(axis=1)
        gain[chosen] = -np.inf
        best = np.argpartition(gain, -8)[-8:] if n > 8 else np.arange(n)
        best = [int(k) for k in best if gain[k] > 1e-6 * max(1.0, counts.sum())]
        if not best:
            break
        used, x = used + best, np.append(x, np.zeros(len(best)))
        chosen[best] = True
        while used:
            m = matrix(used)
            gram = m.T @ m
            gram[np.diag_indices_from(gram)] += 1e-9
            z = np.linalg.solve(gram, m.T @ np.where(np.arange(bins) > 0, counts, 0.0))
            if (z > 0).all():
                x = z
                break
            low = z <= 0
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-12))
            x = x + step * (z - x)
            out = (x <= 1e-9) & low
            chosen[[used[k] for k in np.flatnonzero(out)]] = False
            used, x = [u for u, o in zip(used, out) if not o], x[~out]
        rest = counts - matrix(used) @ x if used else counts.astype(float).copy()
        rest[0] = 0
    result = np.zeros(n)
    result[used] = x
    return result


def plan_windows(counts: np.ndarray, step: int = 1) -> list[tuple[int, dict[int, int]]]:
    """[(repeats, {bin: pieces})] that use every piece of the histogram; a window holds ``len(counts) - 1`` units.

    The fit combines bins that are multiples of ``step``; the greedy rest takes all.
    """
    bins = len(counts) - 1
    left = counts.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[int, dict[int, int]]] = []

    def take(repeats: int, parts: dict[int, int]) -> None:
        if repeats > 0:
            plan.append((int(repeats), parts))
            for k, m in parts.items():
                left[k] -= repeats * m

    def pattern(row) -> dict[int, int]:
        values, times = np.unique(row[row > 0], return_counts=True)
        return dict(zip(values.tolist(), times.tolist()))

    if left.sum():
        coarse = left[::step]
        options = combinations(bins // step)
        options = options[(coarse[options] > 0).all(axis=1, where=options > 0)]
        fit = np.floor(non_negative_fit(options, coarse, rounds=2 * len(coarse) // 8)).astype(np.int64) if len(options) else []
        for k in np.flatnonzero(fit):
            parts = pattern(options[k] * step)
            take(min([int(fit[k])] + [left[b] // m for b, m in parts.items()]), parts)
    while left.sum():
        top = int(np.flatnonzero(left)[-1])
        parts, room = {top: 1}, bins - top
        while room > 0 and (fits := np.flatnonzero(left[: room + 1])).size:
            k = int(fits[-1])
            m = min(room // k, int(left[k]) - parts.get(k, 0))
            if m <= 0:
                smaller = [int(j) for j in fits if left[j] - parts.get(int(j), 0) > 0]
                if not smaller:
                    break
                k = smaller[-1]
                m = min(room // k, int(left[k]) - parts.get(k, 0))
            parts[k] = parts.get(k, 0) + m
            room -= k * m
        take(min(left[b] // m for b, m in parts.items()), parts)
    return plan


def slots(plan: list[tuple[int, dict[int, int]]], first: int) -> dict[int, list[tuple[int, int, int]]]:
    """Per bin, [(first rank, first sequence, pieces per sequence)] in rank order."""
    table: dict[int, list[tuple[int, int, int]]] = {}
    at: dict[int, int] = {}
    sequence = first
    for repeats, parts in plan:
        for b, m in parts.items():
            table.setdefault(b, []).append((at.get(b, 0), sequence, m))
            at[b] = at.get(b, 0) + repeats * m
        sequence += repeats
    return table


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    step: int = 8,
    exact: int = 64,
    end_id: int = 1,
    rows_per_salt: int = 2_000,
) -> DataFrame:
    """Per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (gapless from 0 in its sequence)."""
    cut = token_pieces(docs, tokenizer, id_col=id_col, text_col=text_col, window=window, end_id=end_id)
    rounded = F.least(F.ceil(F.col("length") / step) * step, F.lit(window))
    size = F.when(F.col("length") < exact, F.col("length")).otherwise(rounded)
    pieces = materialize(cut.withColumn("bin", size.cast("int")), "pieces")
    histogram = {r["bin"]: r["count"] for r in pieces.groupBy("bin").count().collect()}
    salts = max(1, sum(histogram.values()) // rows_per_salt)
    counts = np.zeros(window + 1, dtype=np.int64)
    for b, n in histogram.items():
        counts[b] = n
    full = int(counts[window])
    counts[window] = 0
    table = slots([*([(full, {window: 1})] if full else []), *plan_windows(counts, step)], 0)

    key = F.pmod(F.xxhash64("id", "start"), F.lit(salts)).alias("salt")
    keyed = pieces.withColumn("salt", key)
    before = (
        keyed.groupBy("bin", "salt")
        .count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("bin").orderBy("salt")) - F.col("count"))
        .drop("count")
    )
    inside = F.row_number().over(Window.partitionBy("bin", "salt").orderBy("id", "start", "ids_crc32"))
    ranked = keyed.withColumn("inside", inside).join(before, ["bin", "salt"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = {b: tuple(map(np.asarray, zip(*rows))) for b, rows in table.items()}
        for batch in batches:
            b, rank = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            sequence, slot = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            for one in np.unique(b):
                mine = b == one
                starts, firsts, each = lookup[int(one)]
                k = np.searchsorted(starts, rank[mine], side="right") - 1
                sequence[mine] = firsts[k] + (rank[mine] - starts[k]) // each[k]
                slot[mine] = (rank[mine] - starts[k]) % each[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(sequence), pa.array(slot), batch.column(0)],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot", "bin"],
            )

    placed = ranked.select(
        "bin", (F.col("before") + F.col("inside") - 1).cast("long").alias("rank"), "id", "start", "length", "ids_crc32", "doc_tokens"
    ).mapInArrow(place, f"{PIECE}, sequence_id long, slot long, bin int")
    inside_sequence = Window.partitionBy("sequence_id").orderBy(F.desc("bin"), "slot")
    offset = F.sum("length").over(inside_sequence.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return placed.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset")
    )
