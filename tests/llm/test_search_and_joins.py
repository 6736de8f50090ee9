"""Operators that match rows with rows: revisits, near copies, recordings, benchmark windows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import chosen_path, chroma, decontaminate, warc_revisit

RECORD = "record_id long, url string, ts long, warc_type string, status int, headers map<string,string>, digest string, extra string"


def revisits(spark, rows, **options):
    found = warc_revisit.resolve(spark.createDataFrame(rows, RECORD), **options)
    return {r["record_id"]: r for r in found.collect()}


def full(i, url, ts, tag="t", **headers):
    return (i, url, ts, "response", 200, {"ETag": tag, "Content-Type": "text/html", **headers}, f"d{i}", "x")


def again(i, url, ts, headers, digest=None):
    return (i, url, ts, "revisit", 304, headers, digest, "x")


@pytest.mark.parametrize("bucket", [10, 100_000])
def test_revisits_take_the_latest_earlier_response(spark, bucket):
    rows = [
        full(1, "http://WWW.a.org:80/x/?utm_source=q&b=2&a=1#f", 5, "old"),
        full(2, "https://a.org/x?a=1&b=2", 40, "new", Date="1"),
        again(3, "http://a.org/x/?b=2&a=1", 90, {"etag": 'W/new', "Date": "2", "Content-Type": "no", "CONNECTION": "close"}),
        again(4, "http://a.org/x?a=1&b=2", 20, {"etag": "other"}),
        again(5, "http://a.org/x?a=1&b=2", 1, {"etag": "old"}),
        again(6, "http://a.org/y", 50, None),
        again(7, "http://a.org/x?a=1&b=2", 41, {"server": "s"}),
        again(8, "http://a.org/x?a=1&b=2", 42, {"server": "s"}, "d2"),
        again(9, None, None, None),
    ]
    found = revisits(spark, rows, bucket_seconds=bucket)
    assert {k: (r["verdict"], r["refers_to"]) for k, r in found.items()} == {
        3: ("resolved", 2), 4: ("validator_mismatch", 1), 5: ("no_response", None), 6: ("no_response", None),
        7: ("no_validator", 2), 8: ("resolved", 2), 9: ("no_response", None),
    }
    assert found[3]["headers"] == {"etag": "W/new", "content-type": "text/html", "date": "2"}
    assert found[3]["canonical"] == "a.org/x?a=1&b=2" and found[4]["headers"] is None


def test_equal_times_are_ordered_by_id_and_empty_tables_pass(spark):
    found = revisits(spark, [full(2, "a.org", 7), again(1, "a.org", 7, {"etag": "t"}), again(3, "a.org", 7, {"etag": "t"})])
    assert found[1]["verdict"] == "no_response" and found[3]["refers_to"] == 2
    assert revisits(spark, []) == {}


def words(rng, n):
    return [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(n)]


def brute_classes(texts, threshold=0.8):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    head = {}
    for i in sorted(sets):
        head.setdefault(sets[i], i)
    heads = [i for s, i in head.items() if s]
    root, links = {i: i for i in sets}, dict.fromkeys(heads, 0)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(heads)):
        for b in range(a):
            x, y = sets[heads[a]], sets[heads[b]]
            if len(x & y) >= threshold * len(x | y):
                links[heads[a]] += 1
                links[heads[b]] += 1
                p, q = find(heads[a]), find(heads[b])
                root[max(p, q)] = min(p, q)
    return {i: (find(head[s]), links[head[s]]) if s else (i, 0) for i, s in sets.items()}


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [(1000, None), (1001, ""), (1002, "!!! ***"), (1003, "too short"), (1004, "Too SHORT")]
    for base in range(12):
        w = words(rng, rng.choice([8, 60, 200]))
        for copy in range(rng.choice([1, 2, 9])):
            v = list(w)
            for _ in range(copy * len(w) // 90):
                v[rng.randrange(len(v))] = "edit" + str(rng.randrange(10**6))
            texts.append((base * 20 + copy, " ".join(v)))
    texts.append((1005, " ".join(words(rng, 20_000))))
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in texts], "doc_id long, text string, id string, leaf int")
    for block in (4, 512):  # small blocks: cells of two blocks
        found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.similarity_join(docs, block=block, recall=0.999).collect()}
        assert found == brute_classes(texts)


def test_isolated_pairs_at_the_threshold_are_found_by_default(spark):
    rng, texts = random.Random(11), []
    for k in range(600):  # 40 five-grams in common, 5 more in each: 40 of 50
        common = words(rng, 44)
        texts += [(2 * k + j, " ".join(common + [f"own{k}x{j}x{i}" for i in range(5)])) for j in range(2)]
    found = chosen_path.similarity_join(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["class_id"]) for r in found} == {(i, i - i % 2) for i, _ in texts}


def test_near_copies_of_nothing_and_of_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert chosen_path.similarity_join(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    found = chosen_path.similarity_join(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == [(1, 1, 0), (1, 1, 0), (2, 1, 0)]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (7, 8), (5, 5), (1, 2)], "a long, b long")
    assert {r["node"]: r["root"] for r in chosen_path.components(edges).collect()} == {2: 1, 3: 1, 9: 1, 8: 7}


RATE = 4000


def melody(seed, n=24):
    rng = np.random.default_rng(seed)
    time = np.arange(RATE // 8) / RATE
    hertz = 220 * 2 ** (rng.integers(0, 24, (n, 2)) / 12)
    return np.sin(2 * np.pi * hertz[:, :, None] * time).sum(axis=1).ravel() * 8000


def test_recordings_align_at_their_offset(spark):
    noise = np.random.default_rng(1).normal(0, 200, len(melody(1)))
    shifted = np.concatenate([melody(99, 4), melody(1)])
    sounds = {0: melody(1), 1: melody(1) + noise, 2: melody(2), 3: shifted, 4: melody(1), 5: np.zeros(9000), 6: np.zeros(10)}
    rows = [(i, x.astype("<i2").tobytes(), "x") for i, x in sounds.items()] + [(7, None, "x"), (8, b"", "x")]
    audio = spark.createDataFrame(rows, "rec long, pcm binary, id string")
    found = {r["rec"]: r for r in chroma.search(audio, F.col("id") % 2 == 0, id_col="rec", pcm_col="pcm", rate=RATE).collect()}
    assert set(found) == {0, 2, 4, 6, 8}
    matches = {m["match_class"]: m for m in found[0]["matches"]}
    assert set(matches) == {1, 3} and found[0]["n_copies"] == 2 and found[4]["class_id"] == 0
    step = 4 * (RATE // 8) / chroma.HOP
    assert matches[1]["offset"] == 0 and abs(matches[3]["offset"] - step) <= 1
    assert found[2]["matches"] is None and found[8]["class_id"] is None


@pytest.mark.parametrize("short", [512, 1])
def test_recordings_with_noise_in_every_frame_are_found(spark, short):
    rng = np.random.default_rng(7)
    first = rng.integers(0, 2**32, 60, dtype=np.uint32)
    noisy = first ^ (np.uint32(1) << rng.integers(0, 12, 60).astype(np.uint32))  # no whole integer is equal
    shifted = np.concatenate([rng.integers(0, 2**32, 5, dtype=np.uint32), noisy])
    rows = [(0, first), (1, noisy), (2, shifted), (3, rng.integers(0, 2**32, 60, dtype=np.uint32))]
    codes = spark.createDataFrame([(i, c.astype(np.int64).tolist()) for i, c in rows], "id long, codes array<long>")
    found = {r["match_class"]: r for r in chroma.align(codes, F.col("id") == 0, short=short, block_codes=30).collect()}
    assert {k: (r["offset"], r["votes"], r["bit_error_rate"]) for k, r in found.items()} == {1: (0, 60, 1 / 32), 2: (5, 60, 1 / 32)}


@pytest.mark.parametrize("most", [2_000_000, 50])
@pytest.mark.parametrize("short", [512, 1])
@pytest.mark.parametrize("bits", [20, 32])
def test_alignment_equals_brute_force_over_all_offsets(monkeypatch, most, short, bits):
    monkeypatch.setattr(chroma.Block, "most", most)
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 2**32, int(rng.integers(1, 90)), dtype=np.uint32) for _ in range(10)]
    base += [np.full(50, 7, np.uint32), np.full(70, 7, np.uint32)]  # silence of two lengths
    recordings = []
    for k in range(48):
        noise = (np.uint32(1) << rng.integers(0, 32, len(base[k % 12])).astype(np.uint32)) * (rng.random(len(base[k % 12])) < 0.7).astype(np.uint32)
        recordings.append(np.concatenate([rng.integers(0, 2**32, int(rng.integers(0, 9)), dtype=np.uint32), base[k % 12] ^ noise]))
    block = chroma.Block([(i, recordings[i].tobytes()) for i in range(0, 48, 5)], bits)

    def brute(a, b):
        best = None
        for k in sorted(range(-len(a) + 1, len(b)), key=lambda k: (abs(k), k)):
            x, y = a[max(-k, 0) :], b[max(k, 0) :]
            n = min(len(x), len(y))
            differ = x[:n] ^ y[:n]
            equal = sum(int(((differ >> np.uint32(s) & np.uint32(2**bits - 1)) == 0).sum()) for s in {0, 32 - bits})
            share = int(np.bitwise_count(differ).sum(dtype=np.int64)) / (32.0 * n)
            if n >= 24 and equal and share <= 0.15 and (best is None or share < best[2]):
                best = (k, equal, share)
        return best

    some = 0
    for j, codes in enumerate(recordings):
        found = zip(*(c.tolist() for c in block.matches(codes, j, short, 1, 0.15, 24)))
        want = {i: brute(recordings[i], codes) for i in range(0, 48, 5) if i != j}
        want = {i: v for i, v in want.items() if v}
        assert {i: tuple(v) for i, *v in found} == want
        some += len(want)
    assert some > 20


def test_integral_image_equals_plain_sums():
    frames = np.random.default_rng(3).random((40, 12)).astype(np.float32)
    codes = chroma.packed(frames)
    assert len(codes) == 29 and len(chroma.packed(frames[:5])) == 0
    wide = np.hstack([frames, frames])
    _, p, classes, span = chroma.filters()[0]
    half = max(classes // 2, 1)
    a, b = wide[7 : 7 + span, p : p + half].sum(), wide[7 : 7 + span, p + half : p + 2 * half].sum()
    level = np.log((1 + a) / (1 + b))
    assert codes[7] & 3 == (0, 1, 3, 2)[int(level > -0.15) + int(level > 0) + int(level > 0.15)]


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short ITEM!"), (3, None), (4, "..."), (10, "short item")]


@pytest.mark.parametrize("max_windows", [1000, 1])
def test_contamination_by_automaton_and_by_join(spark, max_windows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    text = "Ünd à, ONE two-three four five six seven eight nine ten: stop. short\nitem shorter item"
    rows = [(1, text, 5), (2, None, 5), (3, "", 5), (4, "two three four", 5), (1, text, 5), (5, "x " * 20_000 + "short item", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    found = decontaminate.contamination(docs, items, max_windows=max_windows).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == 6 and (by[1]["n_words"], by[1]["n_hit"], by[1]["items"]) == (17, 12, ["1", "10", "2"])
    assert [text[s["start"] : s["end"]] for s in by[1]["spans"]] == ["ONE two-three four five six seven eight nine ten", "short\nitem"]
    assert by[2]["n_words"] == by[3]["n_words"] == by[4]["n_hit"] == 0 and by[5]["n_hit"] == 2
    carried = decontaminate.contamination(docs, items, max_windows=max_windows, carry=True).select("row.*")
    assert sorted(map(str, carried.collect())) == sorted(map(str, docs.collect()))


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.contamination(some, items).first()["n_hit"] == 0


@pytest.mark.parametrize("max_windows", [100_000, 40])
def test_contamination_equals_brute_force(spark, max_windows):
    rng = random.Random(17)

    def line(n):
        return " ".join(rng.choice(["Alpha", "beta", "ça", "d4", "E"]) + str(rng.randrange(3)) for _ in range(n))

    items = [(k if k % 9 else None, line(rng.choice([0, 1, 3, 10, 14, 30]))) for k in range(60)]
    docs = [(k if k % 11 else None, " ".join(rng.choice([line(4), (rng.choice(items)[1] or "x")]) for _ in range(rng.randrange(6)))) for k in range(80)]

    def words_of(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))

    want = []
    for i, text in docs:
        w, hit, names = words_of(text), set(), set()
        for item, said in items:
            v = words_of(said)
            for k in range(max(len(v) - 9, 1) if v and item is not None else 0):
                win = v[k : k + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        names.add(str(item))
        want.append((i, len(w), len(hit), sorted(names)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(d, b, max_windows=max_windows).collect()
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in found)


def test_large_leaves_are_split_until_small(spark):
    rng = random.Random(23)
    shared = words(rng, 60)  # a passage that all texts hold, with as much text of their own
    texts = [(k, " ".join([*words(rng, 60), *shared, *words(rng, 60)])) for k in range(150)]
    texts += [(1000 + k, " ".join(texts[k][1].split()[: 170 - k % 3])) for k in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sizes = [(2, 3), (512, 3)]
    for block, levels in sizes:
        found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.similarity_join(docs, block=block, levels=levels).collect()}
        assert found == brute_classes(texts)
    signed = chosen_path.signatures(docs, "doc_id", "text", 5, 0.8, 1, 20).where("id < 1000")
    leaves = chosen_path.meeting(chosen_path.materialize(signed.select("id", F.explode("leaves").alias("leaf")), "leaves"))
    split = chosen_path.split_large(leaves, signed, most=8, levels=6, threshold=0.8, spread=1.5)
    before, after = (x.groupBy("leaf").count().where("count > 8").agg(F.sum("count")).first()[0] or 0 for x in (leaves, split))
    assert before > 300 and after < before / 4


def test_every_later_take_is_found_in_the_query(spark, data):
    from tidegauge.llm.queries import LATER, op4_chroma_fingerprints

    found = {r["vec_id"]: r for r in op4_chroma_fingerprints(spark, data).collect()}
    known = [i for i in found if i < LATER and found[i]["class_id"] is not None]
    assert known and all(found[LATER + i]["class_id"] in {m["match_class"] for m in found[i]["matches"] or []} for i in known)
    step = 4 * (RATE // 8) / chroma.HOP
    assert all(min(abs(m["offset"] - step) for m in found[i]["matches"] if m["match_class"] == found[LATER + i]["class_id"]) <= 1 for i in known)


def brute_rows(rows, threshold=0.8):
    """(id, text) rows with the least id and the links of each text's class, texts known by their sets alone."""
    texts = sorted({t for _, t in rows if t})
    sets = {t: frozenset(tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))) for t in texts}
    named = {s: min((i for i, t in rows if t and sets[t] == s and i is not None), default=None) for s in set(sets.values())}
    known = [s for s in named if named[s] is not None]
    link = {s: [o for o in known if o != s and len(s & o) >= threshold * len(s | o)] for s in known}
    least = {}
    for s in known:
        seen, todo = {s}, [s]
        while todo:
            todo += [o for o in link[todo.pop()] if o not in seen and not seen.add(o)]
        least[s] = min(named[o] for o in seen)
    out = []
    for i, t in rows:
        s = sets.get(t)
        out.append((i, least.get(s, i), len(link.get(s, ()))))
    return sorted(out, key=repr)


def test_texts_under_one_id_keep_their_own_links_in_any_order(spark):
    rng = random.Random(31)
    a, b, c = (words(rng, 80) for _ in range(3))

    def near(x):
        return " ".join([*x[:40], "changed", *x[41:]])

    rows = [(9, " ".join(a)), (9, " ".join(b)), (5, near(a)), (8, near(b)), (9, " ".join(b)), (None, near(a)), (None, " ".join(c)), (7, " ".join(c)), (7, near(c))]
    rows += [(None, near(words(rng, 80))), (4, None), (4, ""), (20, " ".join(words(rng, 60))), (20, " ".join(words(rng, 60)))]
    want = brute_rows(rows)
    assert {(9, 5, 1), (9, 8, 1), (7, 7, 1)} <= set(want)
    for _ in range(3):
        rng.shuffle(rows)
        found = chosen_path.similarity_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in found.collect()), key=repr) == want
