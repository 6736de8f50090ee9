"""The pipeline against a version that goes through the documents one by one, and its stages on awkward rows."""

from collections import defaultdict

import pytest
from test_search_and_joins import brute_classes
from test_texts import brute_learned, plain_spans

from tidegauge.llm.queries import tokenizer_file

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    import re

    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def redacted(text, spans):
    """Spans in order of place; overlapping ones become one, named by the first."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"[{('EMAIL', 'IP', 'CARD', 'PHONE')[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def brute_pipeline(docs, items):
    """(doc_id, token ids) of what stays."""
    from tokenizers import Tokenizer

    docs = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    classes = brute_classes(docs)
    docs = [(i, t) for i, t in docs if classes[i][0] == i]
    windows = defaultdict(set)
    for _, said in items:
        v = words_of(said)
        for k in range(max(len(v) - 9, 1) if v else 0):
            windows[len(v[k : k + 10])].add(tuple(v[k : k + 10]))

    def hit(text):
        w = words_of(text)
        return any(tuple(w[p : p + n]) in known for n, known in windows.items() for p in range(len(w) - n + 1))

    docs = [(i, t) for i, t in docs if not hit(t)]
    learned = brute_learned([t for _, t in docs])
    clean = [(i, redacted(t, {*plain_spans(t), *learned[k]})) for k, (i, t) in enumerate(docs)]
    model = Tokenizer.from_file(tokenizer_file())
    return {i: [*model.encode(t, add_special_tokens=False).ids, 1] for i, t in clean}


def test_pipeline_equals_brute_force(spark, data):
    import zlib

    import numpy as np

    import corpus_pipeline as pipeline

    raw = spark.read.parquet(f"{data}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    want = brute_pipeline([(r["doc_id"], r["text"]) for r in raw.collect()], items)
    found, room = defaultdict(list), defaultdict(int)
    for r in pipeline.run(spark, data).collect():
        found[r["doc_id"]].append(r)
        room[r["sequence_id"]] += r["length"]
    assert set(found) == set(want) and max(room.values()) <= 2048
    for i, ids in want.items():
        at = 0
        for r in sorted(found[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], dtype="<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_pass_awkward_rows(spark, data, empty):
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, key int, kind int, _id string, spans string"
    own, other = (" ".join(f"{w}{k} mail me" for k in range(30)) for w in ("own", "other"))
    texts = {
        1: "one two three four five six seven", 2: "One two three four five six seven!", 3: own + " a@b.com now", 4: "x " * 60_000,
    }
    more = (None, None, None, "r", "i", 0, 1, None, "s")
    rows = [(i, t, *more) for i, t in texts.items()]
    rows += [rows[2], rows[2], (None, texts[3], *more), (None, other, *more), (None, other, *more), (None, None, *more), (5, "", *more), (6, "12 !", *more)]
    rows += [(10 + k, f"a label {k} of words", "en", *more[1:]) for k in range(8)]
    docs = spark.createDataFrame([] if empty else rows, schema)
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, data), name)
        assert docs.dtypes == spark.createDataFrame([], schema).dtypes
    if empty:
        assert docs.count() == 0 and pipeline.packing(spark, docs, data).count() == 0
        return
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in docs.where("coalesce(doc_id, 0) < 10").collect())
    assert kept == [(0, other), (1, texts[1]), (3, own + " [EMAIL] now"), (4, texts[4])]
    assert pipeline.packing(spark, docs, data).where("doc_id = 4").count() > 1
