"""Operator 4: chroma audio fingerprints and their alignment.

A recording becomes pitch-class frames (12 energies a frame); rectangles of the
frames are summed on an integral image; 16 differences of rectangle sums, two
bits each, pack into one integer a frame. To align, recordings of equal
fingerprints form one class; query classes go in blocks of bounded size to the
tasks that hold all classes, which look up parts of their integers in a block's
index. A pair that shares a part is decided there: the histogram of its frame
offsets proposes alignments, and bit errors over the overlap decide. Nothing but
matches leaves a task.

A null, empty or too short recording has no fingerprint and no match. Silence
gives equal integers everywhere: a class holds all silent recordings of one
length. Very long recordings are read whole. Repeated rows are one class. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import join_unique, materialize, small_batches

FRAME, HOP, WIDTH = 1024, 256, 12


@cache
def pitch_classes(rate: int) -> np.ndarray:
    """Frequency bin x 12: which bins count for which pitch class (between 27.5 Hz and half the rate)."""
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = hertz >= 27.5
    pitch = np.rint(12 * np.log2(np.maximum(hertz, 1) / 440)).astype(int) % 12
    return ((np.arange(12)[None, :] == pitch[:, None]) & use[:, None]).astype(np.float32)


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames x 12 pitch-class energies, each frame of unit length (silence: zeros)."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12), dtype=np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
    energy = power.astype(np.float32) @ pitch_classes(rate)
    length = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(length > 1e-3, energy / np.maximum(length, 1e-9), 0)


@cache
def filters() -> list[tuple[str, int, int, int]]:
    """16 filters (shape, first pitch class, classes, frames): four shapes over a rule of places and sizes."""
    shapes = ("over", "beside", "centre", "check")
    return [(shapes[k % 4], (5 * k) % 9, 3 + k % 3 + (k // 8), 2 + 2 * (k // 4)) for k in range(16)]


def packed(frames: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for every frame that has ``WIDTH`` frames from it on."""
    n = len(frames) - WIDTH + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint32)
    wide = np.hstack([frames, frames])  # pitch classes are a circle
    image = np.zeros((len(wide) + 1, wide.shape[1] + 1))
    image[1:, 1:] = wide.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t: int, p: int, frames_: int, classes: int) -> np.ndarray:
        return image[at + t + frames_, p + classes] - image[at + t, p + classes] - image[at + t + frames_, p] + image[at + t, p]

    out = np.zeros(n, dtype=np.uint32)
    for k, (shape, p, classes, span) in enumerate(filters()):
        half_c, half_t, span = max(classes // 2, 1), max(span // 2, 1), max(span, 2)
        if shape == "over":
            a, b = area(0, p, span, half_c), area(0, p + half_c, span, half_c)
        elif shape == "beside":
            a, b = area(0, p, half_t, classes), area(half_t, p, half_t, classes)
        elif shape == "centre":
            third = max(WIDTH // 3, 1)
            a, b = 2 * area(third, p, third, classes), area(0, p, third, classes) + area(2 * third, p, third, classes)
        else:
            a = area(0, p, half_t, half_c) + area(half_t, p + half_c, half_t, half_c)
            b = area(half_t, p, half_t, half_c) + area(0, p + half_c, half_t, half_c)
        level = np.log((1 + a) / (1 + b))
        step = (level > -0.15).astype(np.uint32) + (level > 0) + (level > 0.15)
        gray = np.array([0, 1, 3, 2], dtype=np.uint32)[step.astype(int)]
        out |= gray << np.uint32(2 * k)
    return out


def fingerprints(audio: DataFrame, *, id_col: str, pcm_col: str, rate: int) -> DataFrame:
    """(id, codes): packed integers of every recording of 16-bit little-endian samples."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = []
            for raw in b.column(1):
                data = raw.as_py() or b""
                samples = np.frombuffer(data[: len(data) // 2 * 2], dtype="<i2")
                codes.append(packed(chroma(samples / 32768, rate)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.list_(pa.int64()))], names=["id", "codes"])

    small_batches(audio)
    source = audio.select(F.col(id_col).cast("long").alias("id"), F.col(pcm_col).alias("pcm"))
    return source.mapInArrow(take, "id long, codes array<long>")


def parts_of(bits: int) -> list[int]:
    """Where the parts of integers begin that lookups use: low and high bits, or the whole integer."""
    return sorted({0, 32 - bits})


class Block:
    """Query classes, one after the other in one array, with an index of the parts of their integers by part, query and place."""

    most = 2_000_000  #: entries of a histogram, or integers compared, at a time

    def __init__(self, rows: list[tuple[int, bytes]], bits: int):
        self.ids = np.array([i for i, _ in rows], dtype=np.int64)
        self.codes = np.frombuffer(b"".join(c for _, c in rows), dtype="<u4")
        self.sizes = np.array([len(c) // 4 for _, c in rows], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bits, self.index = bits, []
        owner = np.repeat(np.arange(len(rows), dtype=np.int64), self.sizes)
        place = np.arange(len(self.codes)) - np.repeat(self.starts, self.sizes)
        for s in parts_of(bits):
            keys = self.part(self.codes, s) << 32 | owner
            order = np.argsort(keys, kind="stable")
            self.index.append((s, keys[order], place[order]))

    def part(self, codes: np.ndarray, s: int) -> np.ndarray:
        return (codes >> np.uint32(s) & np.uint32((1 << self.bits) - 1)).astype(np.int64)

    def histogram(self, codes: np.ndarray, first: int, last: int) -> np.ndarray:
        """Rows (query, offset, votes): how many parts of queries ``first`` to ``last`` - 1 equal parts of these integers, by frame offset."""
        spans = []
        for s, keys, places in self.index:
            mine = self.part(codes, s) << 32
            spans.append((keys, places, np.searchsorted(keys, mine | first), np.searchsorted(keys, mine | last)))
        if sum(int((hi - lo).sum()) for _, _, lo, hi in spans) > self.most:
            if last - first > 1:
                middle = (first + last) // 2
                return np.hstack([self.histogram(codes, first, middle), self.histogram(codes, middle, last)])
            return self.long_histogram(codes, first, spans)
        met = []
        for keys, places, lo, hi in spans:
            n = hi - lo
            at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            offsets = np.repeat(np.arange(len(codes)), n) - places[at]
            met.append(((keys[at] & 0xFFFFFFFF) << 32) + offsets + 2**31)
        both, votes = np.unique(np.concatenate(met), return_counts=True)
        return np.stack([both >> 32, (both & 0xFFFFFFFF) - 2**31, votes])

    def long_histogram(self, codes: np.ndarray, query: int, spans: list) -> np.ndarray:
        """The same for one query that meets these integers very often, frame by frame in an array of all offsets."""
        n = int(self.sizes[query])
        votes = np.zeros(n + len(codes), dtype=np.int64)
        for _, places, lo, hi in spans:
            for j in np.flatnonzero(hi > lo):
                votes[j - places[lo[j] : hi[j]] + n] += 1  # places of one query are distinct
        at = np.flatnonzero(votes)
        return np.stack([np.full(len(at), query), at - n, votes[at]])

    def matches(self, codes: np.ndarray, other: int, short: int, votes: int, most_errors: float, overlap: int) -> tuple[np.ndarray, ...]:
        """(query class, offset, votes, share of differing bits): the best alignment of every query class that has one."""
        every = len(self.ids)
        groups = [(0, every)] if len(codes) <= short or not every else [(k, k + 1) for k in range(every)]
        found = [self.aligned(self.histogram(codes, *g), codes, other, votes, most_errors, overlap) for g in groups]
        return tuple(np.concatenate(c) for c in zip(*found))

    def aligned(self, met: np.ndarray, codes: np.ndarray, other: int, votes: int, most_errors: float, overlap: int) -> tuple[np.ndarray, ...]:
        query, offset, voted = met
        from_a, from_b = np.maximum(-offset, 0), np.maximum(offset, 0)
        n = np.minimum(self.sizes[query] - from_a, len(codes) - from_b)
        use = (voted >= votes) & (n >= max(overlap, 1)) & (self.ids[query] != other)
        query, offset, voted, n = query[use], offset[use], voted[use], n[use]
        from_a, from_b = from_a[use] + self.starts[query], from_b[use]
        share, ends, k = np.zeros(len(n)), np.cumsum(n), 0
        while k < len(n):
            done = int(ends[k] - n[k])
            to = max(k + 1, int(np.searchsorted(ends, done + self.most, side="right")))
            size, begin = n[k:to], ends[k:to] - n[k:to] - done
            at = np.arange(int(ends[to - 1]) - done)
            differ = self.codes[at + np.repeat(from_a[k:to] - begin, size)] ^ codes[at + np.repeat(from_b[k:to] - begin, size)]
            share[k:to] = np.add.reduceat(np.bitwise_count(differ), begin, dtype=np.int64) / (32.0 * size)
            k = to
        use = np.flatnonzero(share <= most_errors)
        use = use[np.lexsort((offset[use], np.abs(offset[use]), share[use], query[use]))]
        use = use[np.unique(query[use], return_index=True)[1]]
        return self.ids[query[use]], offset[use], voted[use], share[use]


def align(
    codes: DataFrame, queries: Column, *, bits: int = 20, votes: int = 1, most_errors: float = 0.15, overlap: int = 24, short: int = 512,
    block_codes: int = 2_000_000,
) -> DataFrame:
    """Matches between classes: (query_class, match_class, offset, votes, bit_error_rate); and ``classes`` for membership.

    ``codes`` are rows of ``fingerprints``; ``queries`` says which ids ask. The
    best offset of a pair is the one with fewest bit errors among those with
    ``votes`` equal keys and ``overlap`` frames in common. A recording of up to
    ``short`` integers is held against all queries of a block at once, a longer
    one against one query after the other. A block of queries holds about
    ``block_codes`` integers, or one longer recording.
    """
    known = materialize(codes.where(F.size("codes") > 0).withColumn("asks", queries), "fingerprints")
    marked = known.withColumn("print", F.sha2(F.array_join("codes", ","), 256))
    classes = marked.groupBy("print").agg(
        F.min("id").alias("class"), F.count("*").alias("n"), F.max("asks").alias("asks"), F.first("codes").alias("codes")
    )
    classes = materialize(classes, "classes")
    asking = classes.where("asks")
    total = asking.agg(F.sum(F.size("codes"))).first()[0] or 0
    blocks = max(1, -(-total // block_codes))
    tasks = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def decide_with(sent) -> DataFrame:
        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(sent.value, bits)
            for batch in batches:
                out = [[], [], [], [], []]
                for other, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                    theirs = np.asarray(v.values.to_numpy(), dtype=np.uint32)
                    query, *rest = block.matches(theirs, other, short, votes, most_errors, overlap)
                    for column, values in zip(out, (query, np.full(len(query), other), *rest)):
                        column.extend(values.tolist())
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, types)], names=["query_class", "match_class", "offset", "votes", "bit_error_rate"]
                )

        rows = small_batches(classes.select("class", "codes").repartition(tasks, "class"))  # small rows, much work
        return rows.mapInArrow(decide, "query_class long, match_class long, offset long, votes long, bit_error_rate double")

    found = None
    for k in range(blocks):
        rows = asking.where(F.pmod(F.xxhash64("class"), F.lit(blocks)) == k).select("class", "codes").toLocalIterator()
        sent = codes.sparkSession.sparkContext.broadcast([(r["class"], np.array(r["codes"], dtype="<u4").tobytes()) for r in rows])
        found = decide_with(sent) if found is None else found.unionAll(decide_with(sent))
    return found.withColumn("offset", F.col("offset").cast("int"))


def search(audio: DataFrame, queries: Column, *, id_col: str, pcm_col: str, rate: int, **options) -> DataFrame:
    """Per asking recording (``queries``: a condition on ``id``): id_col, class_id (least id with the same fingerprint, null without one) and matches.

    ``matches`` lists other classes in order of class: match_class, offset,
    votes, bit_error_rate. Members of the own class are exact copies.
    """
    prints = F.when(F.size("codes") > 0, F.sha2(F.array_join("codes", ","), 256))
    codes = materialize(fingerprints(audio, id_col=id_col, pcm_col=pcm_col, rate=rate).withColumn("print", prints), "codes")
    pairs = align(codes.select("id", "codes"), queries, **options)
    lists = pairs.groupBy("query_class").agg(
        F.sort_array(F.collect_list(F.struct("match_class", "offset", "votes", "bit_error_rate"))).alias("matches")
    )
    members = codes.where("print is not null").groupBy("print").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"))
    lists = materialize(lists.withColumnRenamed("query_class", "class_id"), "matches")
    own = materialize(join_unique(codes.where(queries).select("id", "print"), members, "print", "left"), "members")
    return join_unique(own, lists, "class_id", "left").select(
        F.col("id").alias(id_col), "class_id", F.coalesce("n_copies", F.lit(0)).alias("n_copies"), "matches"
    )
