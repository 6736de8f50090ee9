"""Operator 3: n-gram Jaccard self-join by chosen paths.

A document is the set of its distinct word five-grams. In every repetition a
set walks a tree of paths: at a node it follows each of its tokens whose hash
(of repetition, path and token) falls under ``1 / (threshold * set size)``, so
sets that share most tokens keep following the same children and others part.
A walk is decided by hashes alone: each document computes its own nodes of depth
``depth``, and only those are shuffled. A node that is still large is split
again on further shared tokens, level by level: texts that share a passage only
part after a few, near copies stay together and are left as they are once a
level shows that. Repetitions go on until a
pair at the threshold meets with probability ``recall``, splits included.

Documents with one token set form a class first, so copies cost one row. The
representatives that meet at a leaf are compared there by min-hash sketches
with a margin below the threshold, in blocks of bounded size; a forest of the
likely pairs, not the pairs, leaves the task. Its connected components are
small candidate sets; each is compared by brute force, in blocks, on its real
sets of hashed tokens. That yields every link inside a component, counted and
not expanded.

Result: one row per document with ``class_id`` (least id of its connected
component of links), ``copy_of`` (least id with the same token set),
``n_links`` (different texts linked to it) and ``n_tokens``. Null, empty and
wordless texts have no tokens and stay alone. Texts under five words are one
token: all their words. Very long texts are read whole. Repeated rows and ties
fall into one class. Texts are known by their token sets throughout, never by
their ids: different texts under one id are rows of their own, each with its own
class and links, whatever the order of the rows. A row without an id shares the
class of the rows with ids that have its text; where there are none, it has
neither class nor links. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import heavy_keys, id_text_row, join_unique, materialize, normalised, whole_groups

#: Bins of a sketch, and how far below the threshold a likely pair may be estimated (over four standard errors).
SKETCH = 128
MARGIN = 0.16
#: Draws that a walk makes at once: nodes of a level times tokens of a set, as many as a core's cache holds.
WALK = 1 << 15
MASK = np.uint64(0x9E3779B97F4A7C15)
SIGNATURE = "id long, n_tokens int, set_hash string, sketch binary, tokens binary, leaves array<long>"


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    words = normalised(text).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    values = mixed(pd.util.hash_array(np.array(words, dtype=object), categorize=False))
    n = max(len(values) - size + 1, 1)
    width = min(size, len(values))
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total = total * MASK + values[k : k + n]
    return np.unique(mixed(total))


def leaf_paths(tokens: np.ndarray, threshold: float, depth: int, repeats: int) -> np.ndarray:
    """Hashes of the leaves that a set reaches in all repetitions."""
    if not len(tokens):
        return np.zeros(0, dtype=np.int64)
    odds = min(1.0, 1.0 / (threshold * len(tokens)))
    limit = np.uint64(min(int(odds * 2.0**64), 2**64 - 1))
    nodes = mixed(np.arange(1, repeats + 1, dtype=np.uint64) * MASK)
    step = max(1, WALK // len(tokens))
    for _ in range(depth):
        children = []
        for some in (nodes[k : k + step] for k in range(0, len(nodes), step)):
            drawn = ((tokens ^ some[:, None]) * MASK).ravel()
            follow = np.flatnonzero(drawn <= limit) if odds < 1 else np.arange(len(drawn))
            children.append(drawn[follow] + some[follow // len(tokens)])
        nodes = np.unique(mixed(np.concatenate(children))) if children else nodes[:0]
        if not len(nodes):
            break
    return nodes.view(np.int64)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """One-permutation min-hash: 16 bits of the least token in each range of hash values, 0 where there is none."""
    edges = np.arange(SKETCH, dtype=np.uint64) << np.uint64(64 - SKETCH.bit_length() + 1)
    first = np.append(np.searchsorted(tokens, edges), len(tokens))
    some = first[1:] > first[:-1]
    least = np.zeros(SKETCH, dtype=np.uint16)
    least[some] = (tokens[first[:-1][some]] >> np.uint64(40)).astype(np.uint16) | np.uint16(1)
    return least


def repeats_for(recall: float, depth: int, levels: int = 0, spread: float = 1.0) -> int:
    """Repetitions until a pair at the threshold shares a leaf with probability ``recall``, after ``levels`` splits, too."""
    meet = 1.0
    for k in range(levels + depth):
        meet = 1.0 - math.exp(-meet * (spread if k < levels else 1.0))
    return max(1, math.ceil(math.log(1.0 - recall) / math.log(1.0 - meet)))


def children_of(leaves: np.ndarray, tokens: np.ndarray, odds: float) -> list[tuple[int, int]]:
    """(leaf, child) for each token of the set that a split of the leaf follows."""
    limit = np.uint64(min(int(odds * 2.0**64), 2**64 - 1))
    spread, found = mixed(tokens.astype(np.uint64) + MASK), []
    for leaf in leaves.tolist():
        node = mixed(np.array([leaf], dtype=np.int64).view(np.uint64) + MASK)[0]
        drawn = mixed(spread ^ node)
        follow = drawn[drawn <= limit] if odds < 1 else drawn
        found += [(leaf, child) for child in mixed(follow + node).view(np.int64).tolist()]
    return found


def meeting(leaves: DataFrame) -> DataFrame:
    """(id, leaf, count) of leaves that more than one row reaches; most leaves are of one document alone and move no further."""
    counts = materialize(leaves.groupBy("leaf").count().where("count > 1"), "counts")
    heavy = heavy_keys(counts, "leaf", leaves.count())
    return materialize(join_unique(leaves, counts, "leaf", heavy=heavy).select("id", "leaf", "count"), "met")


def split_large(leaves: DataFrame, signed: DataFrame, *, most: int, levels: int, threshold: float, spread: float) -> DataFrame:
    """(id, leaf, count) rows in which leaves of over ``most`` rows are split again, up to ``levels`` times.

    A split follows ``spread`` shared tokens of a pair at the threshold on average. A leaf with three children that each
    keep over half of its rows together holds near copies, and stays. ``signed`` has the id, n_tokens and tokens of each set.
    """
    settled, current = [], leaves
    for _ in range(levels):
        settled.append(current.where(F.col("count") <= most))
        hot = current.where(F.col("count") > most)
        if hot.isEmpty():
            break
        sets = signed.select("id", "n_tokens", "tokens").join(hot.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
        asked = hot.groupBy("id").agg(F.collect_list("leaf").alias("leaves")).join(sets, "id").select("id", "n_tokens", "tokens", "leaves")

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for i, n, tokens, of in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                    odds = min(1.0, spread / (threshold * n))
                    found = children_of(np.asarray(of.values), np.frombuffer(tokens.as_py(), dtype="<u4"), odds)
                    out += [(i, leaf, child) for leaf, child in found]
                yield edge_batch(out, ["id", "parent", "leaf"])

        below = materialize(asked.mapInArrow(split, "id long, parent long, leaf long"), "split")
        children = materialize(below.groupBy("parent", "leaf").count().where("count > 1"), "children")
        large = hot.groupBy(F.col("leaf").alias("parent")).agg(F.first("count").alias("n"))
        together = children.join(large, "parent").groupBy("parent").agg(F.count_if(F.col("count") * 2 > F.col("n")).alias("together"))
        stays = materialize(together.where("together > 2").select("parent", F.lit(True).alias("stays")), "stays")
        kept = join_unique(hot, stays.withColumnRenamed("parent", "leaf"), "leaf")
        settled.append(kept.select("id", "leaf", "count"))
        parted = children.join(stays, "parent", "left_anti").select("leaf", "count")
        heavy = heavy_keys(parted, "leaf", below.count())
        current = materialize(join_unique(below.select("id", "leaf"), parted, "leaf", heavy=heavy), "leaves")
    else:
        settled.append(current)
    out = settled[0].select("id", "leaf", "count")
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: float, depth: int, repeats: int) -> DataFrame:
    """Per document: set size, hash of the set, sketch, 32 bits of each token, and leaves."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                t = token_set(text.as_py(), size)
                if not len(t):
                    rows.append((i, 0, None, None, None, []))
                    continue
                whole = f"{int(np.bitwise_xor.reduce(mixed(t))):016x}{int(np.add.reduce(mixed(t + MASK))):016x}{len(t):x}"
                short = np.unique((t >> np.uint64(32)).astype("<u4")).tobytes()
                rows.append((i, len(t), whole, sketch(t).tobytes(), short, leaf_paths(t, threshold, depth, repeats).tolist()))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            names = ["id", "n_tokens", "set_hash", "sketch", "tokens", "leaves"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    return id_text_row(docs, id_col, text_col, carry=False).mapInArrow(sign, SIGNATURE)


def forest(ids: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Edges (member, least member) that join what the given pairs of places join."""
    root = list(range(len(ids)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in zip(rows.tolist(), columns.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(int(ids[k]), int(ids[r])) for k in range(len(ids)) if (r := find(k)) != k]


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the bins that either sketch has in which both agree, row by row."""
    both = ((a == b) & (a > 0)).sum(axis=-1)
    return both / np.maximum(((a > 0) | (b > 0)).sum(axis=-1), 1)


def sketch_forest(ids: np.ndarray, sketches: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Edges that connect rows with sketches alike; a row is compared with those only that are not yet connected to it."""
    label = np.arange(len(ids))
    for k in range(len(ids)):
        others = np.flatnonzero(label != label[k])
        for j in others[alike(sketches[k], sketches[others]) >= least]:
            if label[j] != label[k]:
                yield int(ids[j]), int(ids[k])
                label[label == label[j]] = label[k]


def blocks_of(sized: DataFrame, key: str, salt_of: str, block: int) -> DataFrame:
    """Rows with a ``cell`` (low block, high block): any two rows of one key share a cell, and no cell exceeds about two blocks.

    ``sized`` has the ``count`` of rows of each key.
    """
    sized = sized.where("count > 1").withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    mine = F.pmod(F.xxhash64(salt_of), F.col("blocks")).cast("int")
    cells = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda j: F.struct(F.least(j, F.col("mine")).alias("lo"), F.greatest(j, F.col("mine")).alias("hi")),
        )
    )
    spread = sized.withColumn("mine", mine).withColumn("cell", F.explode(cells)).drop("count", "blocks")
    return spread.withColumn("group", F.xxhash64(key, "cell.lo", "cell.hi"))


def gathered(keyed: DataFrame) -> DataFrame:
    """Rows of one group next to each other."""
    return keyed.repartition("group").sortWithinPartitions("group", "id")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): least node of each connected component, by large-star and small-star rounds.

    The centres of stars are heavy keys by design; ``join_unique`` keeps each from meeting all its edges in one task.
    """
    edges = materialize(edges.select("a", "b").where("a != b").distinct(), "edges")
    before = None
    while True:
        both = materialize(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = join_unique(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
        down = materialize(down, "down")
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = join_unique(down, floor, "a").select("b", "m").union(floor.select("a", "m")).toDF("a", "b").where("a != b").distinct()
        edges = materialize(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Common tokens of every set of ``a`` with every set of ``b``: one product of 0/1 matrices over shared tokens."""
    tokens = np.concatenate([*a, *b])
    values, inverse, times = np.unique(tokens, return_inverse=True, return_counts=True)
    common = times > 1
    place = np.cumsum(common) - 1
    edges = np.cumsum([0, *map(len, a), *map(len, b)])
    total = np.zeros((len(a), len(b)), dtype=np.float32)
    width = int(common.sum())
    step = max(1, 8_000_000 // max(1, len(a) + len(b)))
    columns = [place[inverse[s:e]][common[inverse[s:e]]] for s, e in zip(edges, edges[1:])]
    for lo in range(0, width, step):
        m = np.zeros((len(a) + len(b), min(step, width - lo)), dtype=np.float32)
        for k, c in enumerate(columns):
            m[k, c[(c >= lo) & (c < lo + m.shape[1])] - lo] = 1
        total += m[: len(a)] @ m[len(a) :].T
    return total


def links_of(ids, mine, sizes, sets: list[np.ndarray], lo: int, hi: int, threshold: float) -> list[tuple[int, int, int]]:
    """(id, links, least connected id) of a cell: block ``lo`` against block ``hi``, by real set sizes."""
    left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
    both = intersections([sets[k] for k in left], [sets[k] for k in right])
    linked = both >= threshold * (sizes[left][:, None] + sizes[right][None, :] - both) - 1e-6
    links = np.zeros(len(ids), dtype=np.int64)
    if lo == hi:
        np.fill_diagonal(linked, False)
    else:
        links[right] = linked.sum(axis=0)
    links[left] += linked.sum(axis=1)
    rows, columns = np.nonzero(linked)
    root = dict(forest(ids, left[rows], right[columns]))
    return [(int(i), int(n), root.get(int(i), int(i))) for i, n in zip(ids, links)]


def edge_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def similarity_join(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
    depth: int = 3,
    block: int = 512,
    levels: int = 3,
    spread: float = 1.5,
) -> DataFrame:
    """Per document: id_col, class_id, copy_of, n_links, n_tokens. See the module's text for the method."""
    repeats = repeats_for(recall, depth, levels, spread)
    signed = materialize(signatures(docs, id_col, text_col, size, threshold, depth, repeats), "signatures")
    copies = signed.where("n_tokens > 0").groupBy("set_hash").agg(F.min("id").alias("copy_of"))
    # A set's number is a hash of its hash: ids may repeat over different sets, or be null. From here on ``id`` is that number.
    number = F.xxhash64("set_hash")
    heads = copies.where("copy_of IS NOT NULL").select("set_hash", F.col("copy_of").alias("head"), number.alias("id"))

    def of_heads(*columns: str, asked: DataFrame | None = None) -> DataFrame:
        """(id, columns) of one row of each set, or of those that ``asked`` names: copies, and what is not asked for, are not shuffled."""
        wanted = heads if asked is None else heads.join(asked.select("id").distinct(), "id", "left_semi")
        rows = signed.select(F.col("id").alias("head"), "set_hash", *columns).join(wanted, ["head", "set_hash"])
        return rows.dropDuplicates(["head", "set_hash"]).select("id", *columns)

    leaves = materialize(of_heads("leaves").select("id", F.explode("leaves").alias("leaf")), "leaves")
    leaves = split_large(meeting(leaves), of_heads("n_tokens", "tokens"), most=8 * block, levels=levels, threshold=threshold, spread=spread)
    # Sketches join the few ids that meet at a leaf; all leaves move without them.
    cells = materialize(blocks_of(leaves, "leaf", "id", block).select("group", "id"), "cells")
    cells = cells.join(of_heads("sketch", asked=cells), "id")
    least = threshold - MARGIN

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in whole_groups(batches, "group"):
            ids = rows.column("id").to_numpy()
            sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, SKETCH)
            sizes = np.diff(edges)
            pairs = edges[:-1][sizes == 2]
            pairs = pairs[alike(sketches[pairs], sketches[pairs + 1]) >= least]
            found = list(zip(ids[pairs].tolist(), ids[pairs + 1].tolist()))
            for s, e in zip(edges[:-1][sizes > 2], edges[1:][sizes > 2]):
                found += sketch_forest(ids[s:e], sketches[s:e], least)
            yield edge_batch(found, ["a", "b"])

    likely = gathered(cells.select("group", "id", "sketch")).mapInArrow(near, "a long, b long")
    groups = materialize(_rooted(components(likely)), "components")

    # The one shuffle of token sets; it meets the members of candidate sets only.
    sizes = groups.groupBy("root").count()
    groups = materialize(join_unique(groups, sizes, "root"), "sized")
    groups = groups.withColumnRenamed("node", "id")
    sets = of_heads("n_tokens", "tokens", asked=groups).join(groups, "id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in whole_groups(batches, "group"):
            ids, mine, sizes = (rows.column(c).to_numpy() for c in ("id", "mine", "n_tokens"))
            los, his, tokens = (rows.column(c) for c in ("lo", "hi", "tokens"))
            found = []
            for s, e in zip(edges, edges[1:]):
                sets = [np.frombuffer(t.as_py(), dtype="<u4") for t in tokens.slice(s, e - s)]
                found += links_of(ids[s:e], mine[s:e], sizes[s:e], sets, los[s].as_py(), his[s].as_py(), threshold)
            yield edge_batch(found, ["id", "n_links", "to"])

    spread = blocks_of(sets, "root", "id", block // 2)
    spread = gathered(spread.select("group", "id", "mine", "n_tokens", "tokens", "cell.lo", "cell.hi"))
    checked = spread.mapInArrow(verify, "id long, n_links long, to long")
    checked = materialize(checked, "links")
    counts = checked.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    classes = components(checked.select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "id")
    named = copies.withColumn("id", number).join(classes, "id", "left").join(counts, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = materialize(named.drop("id"), "classes")
    least = named.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    named = join_unique(named, least, "root").drop("root")
    members = join_unique(signed.select("id", "n_tokens", "set_hash"), named, "set_hash", "left")
    return members.select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "copy_of", "id").alias("class_id"),
        F.coalesce("copy_of", "id").alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
    )


def _rooted(found: DataFrame) -> DataFrame:
    """Component rows for the roots, too."""
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())
