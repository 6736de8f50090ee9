"""Fill-in-the-middle: cuts, forms and restoration against a version that lists all lines."""

import hashlib
import random
import re

import duckdb
import pytest

from tidegauge.llm import fill_middle
from tidegauge.llm.queries import QUERIES
from tidegauge.llm.sql import ORACLE

DOCS = "doc_id long, text string, output string, form int"


def brute(i, text, fim=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def awkward():
    rng = random.Random(11)
    pieces = ["\n", "\n", "\n\n", "é", "𝒳", "word ", "\r\n", "\x0b", " ", "<P", "S>", "a" * 50, "tail"]
    texts = [None, "", "\n", "\n\n\n", "no line end", "x\n", "has <S> inside\n", "<M>", "é\n" * 200, "𝒳" * 70_000 + "\n" + "b\n" * 70_000, "\n" * 131_073]
    return texts + ["".join(rng.choices(pieces, k=rng.randrange(400))) for _ in range(200)]


@pytest.mark.parametrize(("every", "fim"), [(1, 100), (3, 100), (64, 70)])
def test_cuts_equal_brute_force_and_restore(spark, every, fim):
    rows = [(i, t, "other", 5) for i, t in enumerate(awkward())] + [(None, "a\nb\nc\n", "x", 1), (3, "\n\n\n", "x", 1)]
    found = fill_middle.fill_in_middle(spark.createDataFrame(rows, DOCS), every=every, fim_percent=fim)
    assert found.columns == ["doc_id", "n_lines", "form", "start_byte", "end_byte", "prefix_chars", "middle_chars", "output"]
    got = found.withColumn("text", fill_middle.restored()).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, t or "")
    for r in got:
        assert (r["n_lines"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], texts[r["doc_id"]], fim)
        assert r["text"] == texts[r["doc_id"]]
        if r["form"] != "plain":
            raw = r["text"].encode()
            assert len(raw[: r["start_byte"]].decode()) == r["prefix_chars"]
            assert len(raw[r["start_byte"] : r["end_byte"]].decode()) == r["middle_chars"]
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_checkpoints_are_sparse_and_exact():
    data = ("é\n" * 1000 + "x").encode()
    index = fill_middle.checkpoints(data, 64)
    assert index.lines == 1001 and len(index.bytes) == 16
    assert index.bytes.tolist() == [64 * 3 * k for k in range(16)] and index.chars.tolist() == [64 * 2 * k for k in range(16)]
    for line in (0, 1, 63, 64, 65, 999, 1000, 1001):
        before = "".join(re.findall(r"[^\n]*\n|[^\n]+", data.decode())[:line])
        assert fill_middle.locate(data, index, line) == (len(before.encode()), len(before))


def test_empty_table_and_bad_parameters(spark):
    empty = spark.createDataFrame([], DOCS)
    assert fill_middle.fill_in_middle(empty).count() == 0
    for bad in ({"every": 0}, {"sentinels": ("a", "a", "b")}, {"sentinels": ("a", "", "b")}):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(empty, **bad)


def test_other_sentinels_and_seeds(spark):
    docs = spark.createDataFrame([(k, f"a{k}\nb\nc<P>\nd") for k in range(40)], "doc_id long, text string")
    marks = ("|p|", "|s|", "|m|")
    rows = fill_middle.fill_in_middle(docs, sentinels=marks, seed="8").withColumn("back", fill_middle.restored(sentinels=marks)).collect()
    assert all(r["back"] == f"a{r['doc_id']}\nb\nc<P>\nd" and r["form"] != "plain" for r in rows)


def test_query_equals_its_sql(spark, data):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    query = db.execute(ORACLE["op11_fill_in_middle"])
    names = [c[0] for c in query.description]
    rows = QUERIES["op11_fill_in_middle"](spark, data)
    assert sorted(rows.columns) == sorted(names)
    assert sorted(map(tuple, rows.select(*names).collect())) == sorted(query.fetchall())
    assert rows.where("output_sha256 is null or restored_sha256 is null").count() == 0
