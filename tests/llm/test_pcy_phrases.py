"""Collocations against a version that counts every phrase in one dictionary."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidegauge.llm import pcy_phrases
from tidegauge.llm.queries import QUERIES
from tidegauge.llm.sql import ORACLE

DOCS = "doc_id long, text string, lang string, phrase string, rank int, hash string"


def brute(rows, longest=3, least=10, share=50, best=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cands.items():
            inside = any(100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items() if len(q) > len(p))
            if not inside:
                cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed=12, docs=150):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "New", "york", "city", "é", "𝒳y", "x\x00y", "x y", "of", "the", "T", "\\", "'", "<P>"] + [f"w{k}" for k in range(60)]
    ends = [" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\r\n", "\x0b", "!", "?:", ";"]
    rows = [(None, None, None, "x", 1, "y"), (1, "", "en", "x", 1, "y"), (2, " \t ", None, "x", 1, "y"), (3, ".,;\n", "zz", "x", 1, "y")]
    for i in range(docs):
        said = "".join(rng.choice(vocabulary[: rng.choice((5, 15, 70))]) + rng.choice(ends) for _ in range(rng.randrange(120)))
        rows.append((i, said + " new york city " * rng.randrange(3), rng.choice(["en", "EN", None, "und", "de 1:x"]), "x", 1, "y"))
    return rows + rows[10:30]


@pytest.mark.parametrize(("longest", "least", "share", "best"), [(3, 10, 50, 2000), (2, 3, 50, 7), (4, 5, 80, 40)])
def test_collocations_equal_brute_force(spark, longest, least, share, best):
    rows = texts()
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    found = pcy_phrases.collocations(docs, longest=longest, min_count=least, share=share, best=best, buckets=1 << 30, bits=1 << 12)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = brute(rows, longest, least, share, best)
    assert len(expected) > 20 and sorted(map(tuple, found.collect())) == expected


def test_exact_arithmetic_beyond_64_bits(spark):
    a, left, right = 3 * 10**12 + 7, 4 * 10**12 + 1, 5 * 10**12 + 3
    rows = [("en", 1, "x", left), ("en", 1, "y", right), ("en", 2, "x y", a)]
    phrases = spark.createDataFrame(rows, "lang string, k int, phrase string, f long")
    found = pcy_phrases.scored(phrases.where("k > 1"), phrases, 3).first()
    assert (found["l"], found["r"], found["score"]) == (left, right, 1_000_000 * a * a // (left * right))


def test_blocks_end_with_pieces_and_lose_nothing(monkeypatch):
    monkeypatch.setattr(pcy_phrases, "TEXT", 64)
    rng = random.Random(3)
    said = ["".join(rng.choice("ab cd.") for _ in range(rng.randrange(600))) for _ in range(40)] + ["x" * 500 + ". y z", "no end " * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", None] * 21).fill_null("und"), pa.array([t.encode() for t in said])], names=["lang", "data"])
    seen = list(pcy_phrases.blocks(iter([batch.slice(0, 30), batch.slice(30)])))
    assert len(seen) > 40
    for lang, at in (("en", 0), ("und", 1)):
        pieces = [p.split() for x, data in seen if x == lang for p in data.split(b"\xff")]
        whole = [p.split() for t in said[at::2] for p in t.encode().split(b".")]
        assert sorted(p for p in pieces if p) == sorted(p for p in whole if p)


def test_bitmaps_have_the_bits_of_frequent_phrases(spark):
    rows = [(i, "a b a b c", "en", "x", 1, "y") for i in range(6)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("lang", "cast(text as binary) data")
    partials = pcy_phrases.counting_pass(docs, 1, 2, 10, 1 << 32, None, None).cache()
    block = pcy_phrases.Block("en", b"a b a b c")
    *_, (value, _) = block.hashes(2)
    counted = np.frombuffer(pcy_phrases.counted_bitmap(partials, 10, 1 << 16), dtype=np.uint8)
    # a b occurs 12 times, b a and b c 6 times
    assert pcy_phrases.has_bit(counted, value[1:5]).tolist() == [True, False, True, False] and np.unpackbits(counted).sum() == 1
    level = partials.where("chunk IS NULL").groupBy("lang", "phrase").agg({"n": "sum"}).toDF("lang", "phrase", "f").where("f >= 10")
    frequent = np.frombuffer(pcy_phrases.frequent_bitmap(pcy_phrases.hashed(level, 1), 1 << 16), dtype=np.uint8)
    assert pcy_phrases.has_bit(frequent, block.of_word[1:]).tolist() == [True, True, True, True, False]
    three = spark.createDataFrame([("en", "b a b"), ("en", "a b a")], "lang string, phrase string").coalesce(1)
    *_, (value, _) = block.hashes(3)
    assert [r[0] for r in pcy_phrases.hashed(three, 3).collect()] == value[[2, 1]].view(np.int64).tolist()


@pytest.mark.parametrize("least", [10, 127, 128, 1000])
def test_counters_come_back_as_they_went(least):
    rng = np.random.default_rng(least)
    ids = [rng.integers(0, 1 << 26, 5000).astype(np.uint64), np.repeat(np.array([0, 5, (1 << 26) - 1], dtype=np.uint64), [3, 200, 2000])]
    seen = {}
    for batch in pcy_phrases.counters_of(ids, least):
        for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            places, n = pcy_phrases.unpacked(data, pcy_phrases.counter_kind(least))
            seen |= {int(chunk) * pcy_phrases.RANGE + p: c for p, c in zip(places.tolist(), n.tolist())}
    values, counts = np.unique(np.concatenate(ids), return_counts=True)
    assert seen == {int(v): min(int(c), least) for v, c in zip(values, counts)}


def test_few_and_many_counters_sum_alike():
    rng = np.random.default_rng(5)
    few, many, sums = pcy_phrases.Range(3, 10), pcy_phrases.Range(3, 10), np.zeros(2000, dtype=int)
    many.add(np.arange(pcy_phrases.RANGE // 32), np.zeros(pcy_phrases.RANGE // 32, dtype=np.uint8))
    for _ in range(6):
        places = np.unique(rng.integers(0, 2000, 900))
        n = rng.integers(1, 8, len(places)).astype(np.uint8)
        sums[places] += n
        few.add(places, n), many.add(places, n)
    expected = (np.flatnonzero(sums >= 10) + 3 * pcy_phrases.RANGE).tolist()
    assert few.all is None and many.all is not None
    assert few.frequent().tolist() == many.frequent().tolist() == expected


def test_empty_table_and_bad_parameters(spark):
    empty = spark.createDataFrame([], DOCS)
    assert pcy_phrases.collocations(empty).count() == 0
    for bad in ({"longest": 1}, {"buckets": 100_000_000}, {"buckets": 1024}, {"bits": 100}, {"min_count": 0}):
        with pytest.raises(ValueError):
            pcy_phrases.collocations(empty, **bad)


def test_query_equals_its_sql(spark, data):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    query = db.execute(ORACLE["op12_collocations"])
    names = [c[0] for c in query.description]
    rows = QUERIES["op12_collocations"](spark, data)
    assert sorted(rows.columns) == sorted(names)
    assert sorted(map(tuple, rows.select(*names).collect())) == sorted(query.fetchall())
