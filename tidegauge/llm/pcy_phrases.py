"""Operator 12: phrase collocations by hashed bucket counts (PCY, DHP) and Apriori pruning.

Pass k reads the texts once. It counts the phrases of k words exactly, and
throws every phrase of k + 1 words that may still be frequent into one of
``buckets`` counters. Most counters of a task are zero, so a task emits the
others, packed by ranges of buckets, and ranges are summed in parallel. The
buckets that reach ``min_count`` are folded into a bitmap of ``bits`` bits, and
so are the frequent phrases of k words. Pass k + 1 gets both as broadcasts and
counts a phrase only if its bit is set and both phrases of k words inside it
are frequent. A bitmap has ``bits`` / 8 bytes whatever the corpus; false
positives cost a counter each and never a result, as counts are exact.

A task holds at most ``HELD`` different phrases and ``IDS`` buckets and emits
partial sums, which Spark combines before and after the shuffle. Counters are
capped at ``min_count``, which cannot change a bit.

Words: A-Z lower-cased, texts split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those
at spaces and tabs. Everything is counted per language. A candidate has 2 to
``longest`` words and occurs ``min_count`` times; its score is the least over
its cuts of ``floor(1000000 a a / (l r))``, in exact decimals. A candidate
inside a longer one that is at least ``share`` percent as frequent goes.

A null language is ``und``, a null text is empty and has no words; repeated
rows count again. Texts of any length are read whole, in blocks that end with a
piece. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.chosen_path import MASK, mixed
from tidegauge.llm.common import join_unique, materialize, small_batches

#: A byte that no UTF-8 text has: the end of a piece.
END = b"\xff"
#: A-Z fold to a-z; these bytes end a piece; a tab is a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
#: Bytes of text that a task works on at once, and different phrases and places in buckets that it holds before it emits them.
TEXT = 1 << 21
HELD = 500_000
IDS = 1 << 22
#: Counters of one range: they are summed together.
RANGE = 1 << 24
PARTIAL = "lang string, phrase string, n long, chunk int, counts binary"
#: Parts of a language among which its best phrases are found first.
PARTS = 64


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, folded text of about ``TEXT`` bytes): joined short texts, or a stretch of a long one that ends with a piece."""
    held, size = defaultdict(list), 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            data = text.as_py().translate(FOLD)
            while len(data) > TEXT and (cut := data.rfind(END, 0, TEXT) + 1 or data.find(END) + 1):
                yield lang, data[:cut]
                data = data[cut:]
            held[lang].append(data)
            size += len(data)
            if size >= TEXT:
                yield from ((k, END.join(v)) for k, v in held.items())
                held, size = defaultdict(list), 0
    yield from ((k, END.join(v)) for k, v in held.items())


def word_hashes(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """A hash for each word in its language."""
    return mixed(pd.util.hash_array(words, categorize=False) ^ mixed(pd.util.hash_array(langs)))


class Block:
    """The words of one block: codes, the distinct words, and hashes of phrases that start at each word."""

    def __init__(self, lang: str, data: bytes):
        tokens = data.replace(END, b" \xff ").split()
        self.codes, self.words = pd.factorize(np.array([END, *tokens], dtype=object))
        self.inside = self.codes > 0  # the end of a piece has code 0
        self.of_word = word_hashes(self.words, np.array([lang], dtype=object))[self.codes]

    def hashes(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hash, whether it lies inside a piece) of the phrases of 1, 2, ... k words at each place."""
        value, inside = self.of_word, self.inside
        yield value, inside
        for j in range(1, k):
            value = mixed(value[:-1] * MASK + self.of_word[j:])
            inside = inside[:-1] & self.inside[j:]
            yield value, inside

    def counted(self, places: np.ndarray, k: int) -> tuple[list[bytes], np.ndarray]:
        """(phrases, counts) of the phrases of k words at these places."""
        known = self.codes[places]
        width = len(self.words)
        for j in range(1, k):
            known, _ = pd.factorize(known * width + self.codes[places + j])
        counts = np.bincount(known)
        first = np.zeros(len(counts), dtype=np.int64)
        first[known[::-1]] = places[::-1]
        some = np.flatnonzero(counts)
        words = [self.words[self.codes[first[some] + j]] for j in range(k)]
        phrases = list(words[0]) if k == 1 else [b" ".join(p) for p in zip(*words)]
        return phrases, counts[some]


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bucket of each hash is set; ``bits`` holds a power of two of them."""
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def partial_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    arrays[1] = arrays[1].cast(pa.string())
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", "n", "chunk", "counts"])


def packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising places in a range and their counts, byte by byte of the steps: equal bytes lie together and compress."""
    steps = np.diff(places, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.ascontiguousarray(steps.T).tobytes() + counts.tobytes()


def unpacked(data: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // (4 + np.dtype(kind).itemsize)
    steps = np.frombuffer(data, dtype=np.uint8, count=4 * n).reshape(4, n).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u4")[:, 0], dtype=np.int64), np.frombuffer(data, dtype=kind, offset=4 * n)


def counter_kind(min_count: int) -> type:
    return np.uint8 if min_count < 128 else np.uint32


def counters_of(ids: list[np.ndarray], min_count: int) -> Iterator[pa.RecordBatch]:
    """Rows of counters, one for each range of buckets that the ids fall into."""
    if ids:
        where, n = np.unique(np.concatenate(ids), return_counts=True)
        n = np.minimum(n, min_count).astype(counter_kind(min_count))
        chunks = (where // RANGE).astype(np.int64)
        edges = np.append(np.flatnonzero(np.diff(chunks, prepend=-1)), len(chunks))
        places = (where % RANGE).astype(np.int64)
        yield partial_batch([(None, None, None, int(chunks[s]), packed(places[s:e], n[s:e])) for s, e in zip(edges, edges[1:])])


def counting_pass(texts: DataFrame, k: int, longest: int, min_count: int, buckets: int, frequent, bucketed) -> DataFrame:
    """Partial counts of phrases of k words, and partial counters of those of k + 1 where any are asked for.

    ``frequent`` and ``bucketed`` are the broadcast bitmaps of the pass before, none in the first pass.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, int]] = defaultdict(dict)
        ids: list[np.ndarray] = []
        before, allowed = (np.frombuffer(x.value, dtype=np.uint8) if x else None for x in (frequent, bucketed))
        for lang, data in blocks(batches):
            block = Block(lang, data)
            *shorter, (value, kept) = block.hashes(k)
            if k > 1:
                known = has_bit(before, shorter[-1][0])
                kept = kept & known[:-1] & known[1:] & has_bit(allowed, value)
            mine, (phrases, counts) = held[lang], block.counted(np.flatnonzero(kept), k)
            for phrase, n in zip(phrases, counts.tolist()):
                mine[phrase] = mine.get(phrase, 0) + n
            if k < longest:
                both = np.flatnonzero(kept[:-1] & kept[1:])
                ids.append(mixed(value[both] * MASK + block.of_word[both + k]) & np.uint64(buckets - 1))
                if sum(map(len, ids)) >= IDS:
                    yield from counters_of(ids, min_count)
                    ids = []
            if sum(map(len, held.values())) >= HELD:
                yield from emitted(held)
        yield from emitted(held)
        yield from counters_of(ids, min_count)

    def emitted(held: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            yield partial_batch([(lang, p, n, None, None) for p, n in counts.items()])
        held.clear()

    return texts.mapInArrow(count, PARTIAL)


class Range:
    """Sums of the counters of one range: a few lie side by side until they are added, many in an array of all buckets."""

    def __init__(self, chunk: int, min_count: int):
        self.chunk, self.min_count, self.all = chunk, min_count, None
        self.few: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, places: np.ndarray, n: np.ndarray) -> None:
        self.few.append((places, n))
        if self.all is not None or sum(len(p) for p, _ in self.few) > RANGE // 64:
            if self.all is None:
                self.all = np.zeros(RANGE, dtype=counter_kind(self.min_count))
            for p, c in self.few:
                self.all[p] = np.minimum(self.all[p] + c, self.min_count)
            self.few = []

    def frequent(self) -> np.ndarray:
        """Buckets that reach ``min_count``."""
        if self.all is not None:
            return np.flatnonzero(self.all >= self.min_count) + self.chunk * RANGE
        places, n = (np.concatenate(x) for x in zip(*self.few))
        places, at = np.unique(places, return_inverse=True)
        return places[np.bincount(at, weights=n) >= self.min_count] + self.chunk * RANGE


def counted_bitmap(partials: DataFrame, min_count: int, bits: int) -> bytes:
    """The buckets whose counters sum to ``min_count``, folded into ``bits`` bits."""
    kind = counter_kind(min_count)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1)):
                if now is None or chunk != now.chunk:
                    yield from found(now)
                    now = Range(chunk, min_count)
                now.add(*unpacked(data.as_py(), kind))
        yield from found(now)

    def found(now: Range | None) -> Iterator[pa.RecordBatch]:
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array(now.frequent(), pa.int64())], names=["hash"])

    chunks = partials.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk")
    return frequent_bitmap(chunks.mapInArrow(add, "hash long"), bits)


def hashed(level: DataFrame, k: int) -> DataFrame:
    """The hashes of phrases of k words, as ``Block`` makes them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            words = np.array([p.as_py().split(b" ") for p in b.column(1)], dtype=object).reshape(-1, k)
            value = word_hashes(words[:, 0], langs)
            for j in range(1, k):
                value = mixed(value * MASK + word_hashes(words[:, j], langs))
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64))], names=["hash"])

    return level.select("lang", F.col("phrase").cast("binary").alias("phrase")).mapInArrow(add, "hash long")


def frequent_bitmap(level: DataFrame, bits: int) -> bytes:
    """One bit a bucket: whether a ``hash`` falls into it. At most ``bits`` / 64 pairs of numbers reach the driver."""
    bucket = F.col("hash").bitwiseAND(bits - 1)
    words = level.select((bucket / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, dtype="<i8")
    out[found.column("word").to_numpy()] = found.column("bit").to_numpy()
    return out.tobytes()


def keyed(lang: Column | str, phrase: Column) -> Column:
    """One text for a language and a phrase; no two pairs share one."""
    return F.concat(F.length(lang).cast("string"), F.lit(":"), lang, F.lit(" "), phrase)


def frequent_phrases(docs: DataFrame, *, lang_col: str, text_col: str, longest: int, min_count: int, buckets: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of all phrases up to ``longest`` words that occur ``min_count`` times, and (lang, n) of all words."""
    spark = docs.sparkSession
    lang, data = F.coalesce(docs[lang_col].cast("string"), F.lit("und")), docs[text_col].cast("binary")
    texts = small_batches(docs).where(docs[text_col].isNotNull()).select(lang.alias("lang"), data.alias("data"))
    levels, totals, frequent, bucketed = [], None, None, None
    for k in range(1, longest + 1):
        partials = materialize(counting_pass(texts, k, longest, min_count, buckets, frequent, bucketed), f"pass-{k}")
        found = partials.where("chunk IS NULL")
        if k == 1:
            totals = found.groupBy("lang").agg(F.sum("n").cast("long").alias("n"))
        sums = found.groupBy("lang", "phrase").agg(F.sum("n").cast("long").alias("f"))
        level = materialize(sums.where(F.col("f") >= min_count), f"phrases-{k}")
        levels.append(level.select("lang", F.lit(k).alias("k"), "phrase", "f"))
        if k < longest:
            frequent = spark.sparkContext.broadcast(frequent_bitmap(hashed(level, k), bits))
            bucketed = spark.sparkContext.broadcast(counted_bitmap(partials, min_count, bits))
    return reduce(DataFrame.unionByName, levels), totals


def scored(candidates: DataFrame, phrases: DataFrame, longest: int) -> DataFrame:
    """Candidates with the l, r and score of their lowest cut; the first of equals."""
    words = F.split("phrase", " ")

    def part(of: Column, start, size) -> Column:
        return F.array_join(F.slice(of, start, size), " ")

    cuts = candidates.withColumn("words", words).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    sides = F.array(
        F.struct(F.lit(True).alias("left"), part(F.col("words"), F.lit(1), F.col("cut")).alias("of")),
        F.struct(F.lit(False).alias("left"), part(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("of")),
    )
    asked = cuts.withColumn("side", F.explode(sides)).select("lang", "phrase", "k", "f", "cut", "side.left", keyed("lang", F.col("side.of")).alias("key"))
    known = phrases.where(F.col("k") < longest).select(keyed("lang", F.col("phrase")).alias("key"), F.col("f").alias("of"))
    both = join_unique(materialize(asked, "cuts"), known, "key")
    by_cut = both.groupBy("lang", "phrase", "k", "f", "cut").agg(
        F.max(F.when(F.col("left"), F.col("of"))).alias("l"), F.max(F.when(~F.col("left"), F.col("of"))).alias("r")
    )
    exact = {c: F.col(c).cast("decimal(18,0)") for c in ("f", "l", "r")}
    square = (exact["f"] * exact["f"] * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    score = by_cut.withColumns({"num": square, "den": (exact["l"] * exact["r"]).cast("decimal(38,0)")})
    score = score.withColumn("score", F.expr("num div den")).drop("num", "den")
    least = F.min(F.struct("score", "cut", "l", "r")).alias("least")
    return score.groupBy("lang", "phrase", "k", "f").agg(least).select("lang", "phrase", "k", F.col("f").alias("a"), "least.score", "least.l", "least.r")


def covered(candidates: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, most): how often the most frequent longer candidate occurs that a phrase lies in."""
    words = F.split("phrase", " ")

    def parts(size: int) -> Column:
        """All phrases of so many words inside a longer one."""
        whole = F.transform(F.sequence(F.lit(1), F.greatest(F.col("k") - size + 1, F.lit(1))), lambda p: F.array_join(F.slice(words, p, size), " "))
        return F.when(F.col("k") > size, whole).otherwise(F.array().cast("array<string>"))

    inner = [parts(size) for size in range(2, longest)]
    if not inner:
        return candidates.select("lang", "phrase", F.col("f").alias("most")).limit(0)
    longer = candidates.where("k > 2").withColumn("inner", F.concat(*inner))
    return longer.select("lang", F.explode("inner").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(
    docs: DataFrame,
    *,
    lang_col: str = "lang",
    text_col: str = "text",
    longest: int = 3,
    min_count: int = 10,
    share: int = 50,
    best: int = 2000,
    buckets: int = 1 << 32,
    bits: int = 1 << 24,
) -> DataFrame:
    """Per language its ``best`` phrases: lang, rank, phrase, a, l, r, n, score. See the module's text for the method.

    ``buckets`` and ``bits`` are powers of two. Counting prunes while there are
    fewer phrases than buckets times ``min_count`` and fewer frequent ones than
    bits; a bitmap takes ``bits`` / 8 bytes in every worker.
    """
    if longest < 2 or min_count < 1 or best < 1:
        raise ValueError("phrases have two words or more, and counts are positive")
    if any(x & (x - 1) for x in (buckets, bits)) or not 64 <= bits <= 1 << 32 or not bits <= buckets <= 1 << 48:
        raise ValueError("bits and buckets are powers of two, bits from 64 to 2^32, buckets from bits to 2^48")
    phrases, totals = frequent_phrases(docs, lang_col=lang_col, text_col=text_col, longest=longest, min_count=min_count, buckets=buckets, bits=bits)
    candidates = phrases.where("k > 1")
    inside = covered(candidates, longest)
    free = candidates.join(inside, ["lang", "phrase"], "left").where(F.coalesce(F.col("most") * 100 < F.col("f") * share, F.lit(True))).select(*candidates.columns)
    kept = scored(free, phrases, longest)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    # A part's best go on, at most ``PARTS * best`` rows a language: no task ranks a whole language.
    first = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    final = first.where(F.col("rank") <= best).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    named = final.where(F.col("rank") <= best).join(totals, "lang")
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
