"""SimHash components against all pairs, and BK-trees against plain distances."""

import random
import re

import numpy as np
import pytest
import xxhash

from tidegauge.llm import simhash_bktree
from tidegauge.llm.queries import QUERIES

DOCS = "doc_id long, text string, code string, component_id int, root string"


def brute_code(text, size=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, ids, radius=4):
    distinct = sorted(set(codes))
    root = {c: c for c in distinct}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for c, i in zip(codes, ids):
        r = find(c)
        known = [x for x in (least.get(r), i) if x is not None]
        least[r] = min(known) if known else None
    return [least[find(c)] for c in codes]


def awkward():
    rng = random.Random(13)
    words = [f"w{k}" for k in range(400)] + ["É", "𝒳", "x\x00", "a\xa0b", "THE"]
    texts = [None, "", " \t\r\n", "one", "One", "one two three", "one two three four", "z " * 70_000]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice((30, 120, 300)))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            near = list(base)
            for _ in range(rng.randrange(4)):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", " \t "]).join(near))
    return texts + texts[8:20]


def test_components_equal_brute_force(spark):
    rows = [(100 + i, t, "x", 1, "y") for i, t in enumerate(awkward())]
    rows += [(7, "first text under this id", "x", 1, "y"), (7, "quite another one under it", "x", 1, "y"), (None, rows[9][1], "x", 1, "y")]
    rows += [(None, "nobody else says this at all", "x", 1, "y"), rows[12], rows[12]]
    random.Random(1).shuffle(rows)
    found = simhash_bktree.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), block=8)
    assert found.columns == ["doc_id", "code", "component_id"]
    codes = [brute_code(r[1]) for r in rows]
    expected = [(r[0], c - (1 << 64) if c >> 63 else c, k) for r, c, k in zip(rows, codes, brute_components(codes, [r[0] for r in rows]))]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert len({k for *_, k in expected}) < len(set(codes)) < len(rows)


def near_codes(rng, groups, size):
    out = []
    for _ in range(groups):
        code = rng.getrandbits(64)
        for _ in range(size):
            for _ in range(rng.randrange(6)):
                code ^= 1 << rng.randrange(64)
            out.append(code)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("radius", [0, 1, 4, 9])
def test_trees_find_what_plain_distances_find(radius):
    rng = random.Random(radius)
    codes = np.array(near_codes(rng, 12, 40) + [0, (1 << 64) - 1], dtype=np.uint64)
    tree = np.sort(np.array([rng.randrange(5) for _ in codes]))
    trees = simhash_bktree.grow(codes, tree, 6)
    assert trees.roots[5] == -1 and len(trees.children) == len(codes) - 5
    asked, of = codes[::-1].copy(), np.array([rng.randrange(6) for _ in codes])
    found = set(zip(*(x.tolist() for x in simhash_bktree.within(trees, asked, of, radius))))
    assert found == {
        (q, n) for q in range(len(asked)) for n in range(len(codes)) if of[q] == tree[n] and int(asked[q] ^ codes[n]).bit_count() <= radius
    }


def test_children_hang_by_their_distance():
    codes = np.array([0, 1, 2, 3, 7, 4], dtype=np.uint64)
    trees = simhash_bktree.grow(codes, np.zeros(6, dtype=int), 1)
    # root 0: code 1 at distance 1, 3 at 2, 7 at 3; below 1: 2 at distance 2, and below that 4
    hung = {(int(codes[k // 65]), k % 65): int(codes[c]) for k, c in zip(trees.edges.tolist(), trees.children.tolist())}
    assert hung == {(0, 1): 1, (0, 2): 3, (0, 3): 7, (1, 2): 2, (2, 2): 4}


@pytest.mark.parametrize(("radius", "m"), [(4, 5), (4, 6), (4, 7), (4, 8), (1, 2)])
def test_linked_fingerprints_always_share_a_shard(spark, radius, m):
    rng, rows = random.Random(m), []
    for k in range(200):
        code = rng.getrandbits(64)
        other = code
        for b in rng.sample(range(64), radius):
            other ^= 1 << b
        rows += [(k, int(np.uint64(x).astype(np.int64))) for x in (code, other)]
    from pyspark.sql import functions as F

    named = spark.createDataFrame(rows, "k long, code long").select("k", "code", F.explode(simhash_bktree.shards("code", m, radius)).alias("s"))
    met = named.groupBy("k", "s").agg(F.countDistinct("code").alias("n")).where("n = 2")
    assert met.select("k").distinct().count() == 200


def test_more_rows_take_more_bits():
    assert [simhash_bktree.blocks_for(n, 4) for n in (0, 1000, 10**7, 10**9, 10**12)] == [5, 5, 6, 7, 8]


def test_empty_table_and_bad_parameters(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash_bktree.near_duplicates(empty).count() == 0
    for bad in ({"size": 0}, {"radius": 17}, {"block": 1}):
        with pytest.raises(ValueError):
            simhash_bktree.near_duplicates(empty, **bad)


def test_query_equals_brute_force(spark, data):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    codes = [brute_code(t) for _, t in texts]
    expected = {i: (f"{c:016x}", k) for (i, _), c, k in zip(texts, codes, brute_components(codes, [i for i, _ in texts]))}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op13_simhash_near_dedup"](spark, data).collect()}
    assert found == expected
