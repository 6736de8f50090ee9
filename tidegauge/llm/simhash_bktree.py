"""Operator 13: near copies by SimHash fingerprints and BK-trees.

A fingerprint has the bits that over half of a text's word shingles have in
their 64-bit hashes. Two texts are linked if their fingerprints differ in at
most ``radius`` bits; a component is what links reach.

Equal fingerprints are one row. The others are dealt to shards by some of their
bits: of ``m`` blocks of bits two linked fingerprints have ``m - radius`` in
common, so with a shard for the content of every choice of so many blocks they
meet, always. ``m`` follows from the number of fingerprints and keeps the
expected shard small; it never changes a result. A shard of more than ``block``
rows is cut into blocks that hash alone decides.

A task builds a BK-tree of each block it gets: a child hangs under its parent
by their Hamming distance, one child a distance. Each tree answers the
fingerprints of its own block and of those other blocks of the shard that are
sent to it, following from a node at distance d only the edges d - radius to
d + radius. All trees of a batch grow and are searched together, level by level,
as arrays. A forest of the links, not the links, leaves the task, and connected
components follow by star contraction. Trees are not broadcast through the
driver, as they hold the fingerprints of all documents; they meet their queries
in the shuffle by shard.

Words are lower-cased in A-Z and parted at spaces and \\x09-\\x0D; a text of
fewer words than a shingle is one shingle. A null or wordless text has
fingerprint zero, which links like any other. Repeated rows, ties and texts
under one id are rows with a fingerprint each; a component's id is the least of
its rows' ids, null if none has one. Very long texts are read whole, shingles in
blocks. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.chosen_path import blocks_of, components, edge_batch, gathered, meeting
from tidegauge.llm.common import id_text_row, join_unique, materialize, whole_groups

#: Seed of the shingles' hash, and shingles whose bits are counted at once.
SEED = 42
STEP = 1 << 14
#: Expected rows of a shard above which fingerprints are dealt by more bits.
SHARD = 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(data: bytes, size: int) -> int:
    """The bits set in over half of the shingles' hashes; zero without words."""
    words = data.translate(LOWER).split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(len(words) - size + 1, 1)
    cuts = list(zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist()))
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, STEP):
        part = cuts[lo : lo + STEP]
        hashes = np.fromiter((xxhash.xxh64_intdigest(text[s:e], SEED) for s, e in part), dtype="<u8", count=len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, code): each row's fingerprint as a signed 64-bit number."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.array([fingerprint(t.as_py() or b"", size) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes.view(np.int64))], names=["id", "code"])

    rows = id_text_row(docs, id_col, text_col, carry=False)
    return rows.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(sign, "id long, code long")


def blocks_for(rows: int, radius: int) -> int:
    """Blocks of bits among which ``radius`` may differ: the fewest that leave about ``SHARD`` random rows a shard."""
    for m in range(radius + 1, radius + 5):
        if rows * 2.0 ** (-64 * (m - radius) / m) <= SHARD:
            return m
    return radius + 4


def shards(code: str, m: int, radius: int) -> Column:
    """The shards of a fingerprint: one for each choice of ``m - radius`` blocks, named by the bits in them."""
    edges = [round(64 * k / m) for k in range(m + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    chosen = [sum(c) for c in combinations(masks, m - radius)]
    signed = [mask - (1 << 64) if mask >> 63 else mask for mask in chosen]
    return F.array(*(F.xxhash64(F.lit(k), F.col(code).bitwiseAND(F.lit(mask))) for k, mask in enumerate(signed)))


class Trees(NamedTuple):
    """BK-trees side by side: ``edges`` are (parent, distance) keys in order, ``children`` hang there, ``roots`` by tree."""

    codes: np.ndarray
    roots: np.ndarray
    edges: np.ndarray
    children: np.ndarray


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def grow(codes: np.ndarray, tree: np.ndarray, trees: int) -> Trees:
    """A tree for each number in ``tree``: its first code is the root; of the codes that come to a node, the first at each distance is its child.

    Codes of one tree are different. Roots are -1 for numbers without a code.
    """
    roots = np.full(trees, -1, dtype=np.int64)
    numbers, first = np.unique(tree, return_index=True)
    roots[numbers] = first
    at = roots[tree]
    falling = np.flatnonzero(at != np.arange(len(codes)))
    edges, children = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    while len(falling):
        keys = at[falling] * 65 + distance(codes[falling], codes[at[falling]])
        found, first, of = np.unique(keys, return_index=True, return_inverse=True)
        edges.append(found)
        children.append(falling[first])
        at[falling] = falling[first][of]
        falling = falling[at[falling] != falling]
    keys = np.concatenate(edges)
    order = np.argsort(keys)
    return Trees(codes, roots, keys[order], np.concatenate(children)[order])


def within(trees: Trees, codes: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node): all nodes of a query's tree within ``radius`` bits, found along edges d - radius to d + radius."""
    query = np.flatnonzero(trees.roots[tree] >= 0)
    node = trees.roots[tree[query]]
    queries, nodes = [], []
    while len(query):
        d = distance(codes[query], trees.codes[node])
        near = d <= radius
        queries.append(query[near])
        nodes.append(node[near])
        low = np.searchsorted(trees.edges, node * 65 + np.maximum(d - radius, 0))
        many = np.searchsorted(trees.edges, node * 65 + np.minimum(d + radius, 64), side="right") - low
        query = np.repeat(query, many)
        node = trees.children[np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(query))]
    return (np.concatenate(queries), np.concatenate(nodes)) if queries else (query, node)


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least that the links a-b reach."""
    least = np.arange(n)
    while True:
        before, m = least.copy(), np.minimum(least[a], least[b])
        np.minimum.at(least, a, m)
        np.minimum.at(least, b, m)
        least = least[least]
        if (least == before).all():
            return least


def linked_cells(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """(a, b) edges of a forest of the links in each cell: block ``lo`` as a tree, block ``hi`` as its queries."""
    for rows, edges in whole_groups(batches, "group"):
        ids, mine, lo, hi = (rows.column(c).to_numpy() for c in ("id", "mine", "lo", "hi"))
        cell = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        codes = ids.view(np.uint64)
        planted, asked = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        for s, e in parts_of(cell[planted], cell[asked]):
            t, q = planted[slice(*s)], asked[slice(*e)]
            if len(t) and len(q):
                base = min(cell[t[0]], cell[q[0]])
                many = max(cell[t[-1]], cell[q[-1]]) - base + 1
                found, node = within(grow(codes[t], cell[t] - base, many), codes[q], cell[q] - base, radius)
                least = least_reached(len(ids), q[found], t[node])
                joined = np.flatnonzero(least != np.arange(len(ids)))
                yield edge_batch(list(zip(ids[joined].tolist(), ids[least[joined]].tolist())), ["a", "b"])
    yield edge_batch([], ["a", "b"])


def parts_of(planted: np.ndarray, asked: np.ndarray, rows: int = 4096) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
    """Stretches of whole cells with about ``rows`` tree rows or one cell, as places in both sorted arrays of cell numbers."""
    s = 0
    while s < len(planted):
        last = planted[min(s + rows, len(planted)) - 1]
        e = int(np.searchsorted(planted, last, side="left")) if last != planted[s] and s + rows < len(planted) else int(np.searchsorted(planted, last, side="right"))
        yield (s, e), (int(np.searchsorted(asked, planted[s], side="left")), int(np.searchsorted(asked, planted[e - 1], side="right")))
        s = e


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4,
    radius: int = 4,
    block: int = 1024,
) -> DataFrame:
    """Per row: id_col, code (the fingerprint as a signed number) and component_id. See the module's text for the method."""
    if size < 1 or not 0 <= radius <= 16 or block < 2:
        raise ValueError("shingles have words, the radius is 0 to 16 bits, blocks have rows")
    signed = materialize(signatures(docs, id_col, text_col, size), "signatures")
    known = materialize(signed.groupBy("code").agg(F.min("id").alias("least")), "fingerprints")
    m = blocks_for(known.count(), radius)
    leaves = known.select(F.col("code").alias("id"), F.explode(shards("code", m, radius)).alias("leaf"))
    cells = blocks_of(meeting(materialize(leaves, "shards")), "leaf", "id", block)
    rows = gathered(cells.select("group", "id", "mine", "cell.lo", "cell.hi"))
    links = rows.mapInArrow(lambda batches: linked_cells(batches, radius), "a long, b long")
    roots = components(links).withColumnRenamed("node", "code")
    named = materialize(known.join(roots, "code", "left").withColumn("root", F.coalesce("root", "code")), "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = join_unique(named.select("code", "root"), least, "root").select("code", "component_id")
    found = join_unique(signed, classes, "code")
    return found.select(F.col("id").alias(id_col), "code", "component_id")
