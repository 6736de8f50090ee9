"""Operators on single texts: personal data, pages, chats, quality, language, packing, and the pipeline."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import chat_format, host_suffix, language_id, packing_nnls, pii_bootstrap, quality_rff
from tidegauge.llm.queries import QUERIES, tokenizer_file

DOCS = "doc_id long, text string, kind string, key int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in twice) % 10 == 0


def fits(kind, body):
    digits = re.sub("[^0-9]", "", body)
    return {
        "email": True, "ip": kind == "ip" and all(int(x) < 256 for x in body.split(".")),
        "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
    }[kind]


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if fits(kind, m.group())]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)


def test_base_spans_equal_python_patterns(spark):
    rng = random.Random(2)
    pieces = ["a.b@c.d", "@", "x@y", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (234) 555-6789", "+", ". ", " ", "é𝒳", "-", "12", "a@b.c%d@e.f", "\n"]
    texts = [None, "", "1." * 3000, "a.b" * 3000 + "@x.y", *("".join(rng.choices(pieces, k=12)) for _ in range(300))]
    found = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in pii_bootstrap.extract(docs_of(spark, texts)).collect()}
    assert found == {i: plain_spans(t) for i, t in enumerate(texts)}


def test_patterns_find_what_the_base_misses(spark):
    rng = random.Random(3)

    def phone():
        return f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"

    texts = [f"word call {phone()} today" for _ in range(40)] + [f"word call {phone()} 4532015112830366 today", "version 4.0 of 2024-01-01 and 12345678901"]
    rows = {r["doc_id"]: r for r in pii_bootstrap.extract(docs_of(spark, texts)).collect()}
    assert rows[40]["base"] == [] and [tuple(s) for s in rows[40]["spans"]][-1] == (3, 10, 27)
    assert rows[41]["spans"] == [] and all(r["spans"][: len(r["base"])] for i, r in rows.items() if i < 40)
    clean = pii_bootstrap.redact(docs_of(spark, texts), pii_bootstrap.extract(docs_of(spark, texts))).orderBy("doc_id").collect()
    assert clean[0]["text"] == "word call [PHONE] today" and clean[41]["text"] == texts[41] and len(clean) == 42


def shape_of(body):
    return re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "9", body))


def around(text, pattern):
    """(start, end, body, left word, right word) of all matches."""
    found = list(re.finditer(pattern, text))
    edges = [0, *(x for m in found for x in m.span()), len(text)]
    for k, m in enumerate(found):
        before, after = text[edges[2 * k] : m.start()], text[m.end() : edges[2 * k + 3]]
        yield m.start(), m.end(), m.group(), re.split(r"\s+", before[-40:].rstrip(" "))[-1].lower(), re.split(r"\s+", after[:40].lstrip(" "))[0].lower()


def brute_instances(text, most=19, max_tokens=4):
    seeds, runs = [], []
    for kind, pattern in PATTERNS.items():
        seeds += [(kind, s, e, (shape_of(b), left, right)) for s, e, b, left, right in around(text, pattern) if fits(kind, b)]
    for at, _, body, left, right in around(text, pii_bootstrap.ZONE):
        t = body.split(" ")
        for i in range(len(t)):
            for n in range(1, min(most, len(t) - i) + 1):
                run = " ".join(t[i : i + n])
                lead = len(re.match(r"[^0-9A-Za-z+(]*", run).group())
                inner = re.sub(r"[^0-9A-Za-z)]+$", "", run[lead:])
                s = at + sum(len(x) + 1 for x in t[:i]) + lead
                if any(a < s + len(inner) and b > s for _, a, b, _ in seeds):
                    continue
                kinds = [k for k in PATTERNS if re.search(pii_bootstrap.LOOSE[k], inner) and fits(k, inner)]
                words = (t[i - 1].lower() if i else left, t[i + n].lower() if i + n < len(t) else right)
                if n <= max_tokens or kinds:
                    runs.append((kinds, s, s + len(inner), (shape_of(inner), *words)))
    return seeds, runs


def brute_learned(texts, rounds=3, support=5, accept=0.75, trust=0.5):
    """Spans that the bootstrap adds, one row after the other."""
    every = [brute_instances(t or "") for t in texts]
    sure, total, open_ = defaultdict(int), defaultdict(int), defaultdict(int)
    for seeds, runs in every:
        for kind, *_, views in seeds:
            for v in enumerate(views):
                sure[v, kind] += 1
                total[v] += 1
        for kinds, *_, views in runs:
            for v in enumerate(views):
                total[v] += 1
            for k in kinds:
                open_[views, k] += 1
    points = dict.fromkeys(open_, 0)
    for _ in range(rounds):
        likely, promoted = defaultdict(int), defaultdict(int)
        for (views, kind), n in open_.items():
            for v in enumerate(views):
                likely[v, kind] += n * points[views, kind]
                promoted[v, kind] += n * (points[views, kind] >= accept * 10**6)
        by = {k: (sure[k] * 10**6 + likely[k]) // (total[k[0]] + 1) for k in likely if sure[k] + promoted[k] >= support}
        for views, kind in open_:
            c = [by.get((v, kind), 0) for v in enumerate(views)]
            c = [x / 10**6 if x >= trust * 10**6 else 0 for x in c]
            points[views, kind] = round((1 - (1 - c[0]) * (1 - c[1]) * (1 - c[2])) * 10**6)
    out = {}
    for i, (_, runs) in enumerate(every):
        new = sorted({(list(PATTERNS).index(k), s, -e) for kinds, s, e, views in runs for k in kinds if points[views, k] >= accept * 10**6})
        kept = []
        for kind, s, e in new:
            if not any(k == kind and b > s for k, _, b in kept):
                kept.append((kind, s, -e))
        out[i] = kept
    return out


def learned_corpus():
    rng = random.Random(12)
    texts = [f"pay with card {rng.choice(['4532015112830366', '4111111111111111', '4111111111111112'])} now" for _ in range(30)]
    texts += [f"call {rng.randrange(10)}{rng.randrange(10)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)} today" for _ in range(7)]
    texts += [f"call +1 {rng.randrange(200, 999)} {rng.randrange(1000, 9999)} today" for _ in range(90)]
    texts += [f"ring {rng.randrange(10, 99)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)} {'soon' if k else 'today'}" for k in range(2)]
    texts += [f"id 12345 {c} paid" for c in ("4532015112830366", "4532015112830367") for _ in range(6)]
    return [*texts, "version 2024 01 01 of 12 345 6789", None, "", "(1 2 3 4 5 6 7 8 9)", "1 " * 300]


def test_learned_spans_equal_brute_force_in_any_order(spark):
    texts = learned_corpus()
    want = brute_learned(texts)
    assert any(want[i] for i, t in enumerate(texts) if t and t.startswith("call")) and any(want[i] for i, t in enumerate(texts) if t and t.startswith("ring"))
    docs = docs_of(spark, texts)
    for rows in (docs.coalesce(1), docs.orderBy(F.desc("doc_id")).coalesce(1), docs.repartition(7)):
        found = {r["doc_id"]: ({tuple(x) for x in r["spans"]} - {tuple(x) for x in r["base"]}) for r in pii_bootstrap.extract(rows).collect()}
        assert found == {i: set(x) for i, x in want.items()}


def test_redaction_of_null_ids_and_clashing_columns(spark):
    schema = "_id string, doc_id long, text string, _key int, spans string, row int, end int, x int"
    rows = [("a", None, "mail a@b.com now", 1, "s", 2, 3, 4), ("b", None, None, 1, "s", 2, 3, 4), ("c", 5, "1.2.3.4 and x@y.zz", 1, "s", 2, 3, 4), ("c", 5, "1.2.3.4 and x@y.zz", 1, "s", 2, 3, 4)]
    docs = spark.createDataFrame(rows, schema)
    clean = pii_bootstrap.redact(docs, pii_bootstrap.extract(docs))
    texts = {"a": "mail [EMAIL] now", "b": None, "c": "[IP] and [EMAIL]"}
    assert clean.schema == docs.schema
    assert sorted(map(tuple, clean.collect())) == sorted((r[0], r[1], texts[r[0]], *r[3:]) for r in rows)


def test_personal_data_of_nothing(spark):
    empty = docs_of(spark, ["x"]).limit(0)
    assert pii_bootstrap.extract(empty).count() == 0
    twice = docs_of(spark, ["a@b.c"]).unionAll(docs_of(spark, ["a@b.c"]))
    assert [len(r["spans"]) for r in pii_bootstrap.extract(twice).collect()] == [1, 1]


PAGE = '<html><head><title>t</title></head><body><nav><a>Home</a></nav>{}<footer>foot</footer></body></html>'


def test_articles_are_kept_whole(spark):
    article = '<article><header><h1>Head &amp; line</h1></header><p>one <b>bo</b>ld<br>two<script>var x="</p>";</script><p>a &lt; b</p><div class="ad">buy</div><form><p>f</form><section class="comments"><p>nice</section></article>'
    rows = [(1, "http://h/1", PAGE.format(article)), (2, "http://h/2", PAGE.format(article)), (3, None, None), (4, "http://[", ""), (5, "x", "no markup"), (5, "x", "no markup")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = sorted((r["page_id"], r["text"]) for r in host_suffix.extract(pages).collect())
    text = "Head & line\none bold\ntwo\na < b"
    assert found == [(1, text), (2, text), (3, ""), (4, ""), (5, "no markup"), (5, "no markup")]
    assert host_suffix.extract(pages.limit(0)).count() == 0


def test_repeats_across_a_host_are_dropped_without_an_article(spark):
    notice = " ".join(f"legal{k}" for k in range(12))
    own = {i: " ".join(f"w{i}x{k}" for k in range(30)) for i in range(40)}
    rows = [(i, f"http://{'big' if i else 'small'}.org/{i}", PAGE.format(f"<div>{notice}</div><div>{own[i]} {notice}</div>")) for i in own]
    found = {r["page_id"]: r["text"] for r in host_suffix.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: own[i] if i else f"{notice}\n{own[0]} {notice}" for i in own}


def test_copies_of_an_article_without_a_tag_stay(spark):
    body = " ".join(f"body{k}" for k in range(40))
    notice = " ".join(f"legal{k}" for k in range(12))
    rows = [(i, f"http://h.org/{i}", f"<div>{notice}</div><div>{body if i < 2 else f'own{i} ' * 20}</div>") for i in range(8)]
    found = {r["page_id"]: r["text"] for r in host_suffix.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: body if i < 2 else ("own%d " % i * 20).strip() for i in range(8)}


def brute_covered(streams, shortest):
    """Per page, the tokens inside a run of ``shortest`` that another page of the host has, too."""
    at = defaultdict(set)
    for page, words in streams.items():
        for k in range(len(words) - shortest + 1):
            at[tuple(words[k : k + shortest])].add(page)
    return {p: {k + j for k in range(len(w) - shortest + 1) if len(at[tuple(w[k : k + shortest])]) > 1 for j in range(shortest)} for p, w in streams.items()}


def test_suffix_array_equals_brute_force(spark):
    rng = random.Random(4)
    streams = {p: [rng.choice("ab") for _ in range(40)] for p in range(6)}
    rows = [(p, "http://h.org/", f"<div>{' '.join(w)}</div>") for p, w in streams.items()]
    found = {r["page_id"]: r["text"] for r in host_suffix.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    covered = brute_covered(streams, 8)
    assert found == {p: " ".join(x for k, x in enumerate(w) if k not in covered[p]) for p, w in streams.items()}


def test_class_names_and_quotes_empty_no_page():
    def text(page):
        kinds, blocks = host_suffix.blocks_of_page(page)
        return [b for k, b in zip(kinds, blocks) if k == host_suffix.KEEP]

    story = "<article><p title=it's>one two</p><p>it's three</p></article>"
    for page in (story, f'<html class="no-js modal-ready"><body class="cookies-not-set widget">{story}</body></html>', f'<main class="search">{story}</main>', f'<div class="no-ads">{story}</div>'):
        assert text(page) == ["one two", "it's three"]
    assert text('<article class="post promo"><p>a</p><article class="comment">no</article><div class="cookie-banner">no</div></article>') == ["a"]
    assert text("<article><p title='a>b' data-x=\"c>d\">in</p><a href=x=\"y>z</article>") == ["in", "z"]
    assert text("<article>" + "<p a='" * 3000) == ["<p a='" * 3000]  # no end of a tag: text, and no time lost


def brute_extract(pages, shortest=8, copies=0.1):
    """The rule of module host_suffix over distinct (id, url, html), one page after the other."""
    parsed = {}
    for page in dict.fromkeys(pages):
        kinds, blocks = host_suffix.blocks_of_page(page[2] or "")
        undecided = host_suffix.KEEP not in kinds and host_suffix.OPEN in kinds
        parsed[page] = (host_suffix.host_of(page[1]), kinds if undecided else [host_suffix.DROP if k == host_suffix.OPEN else k for k in kinds], blocks, undecided)
    out = {}
    for page, (host, kinds, blocks, undecided) in parsed.items():
        others = [v for p, v in parsed.items() if p != page and v[0] == host]
        streams = {p: [w for k, b in zip(v[1], v[2]) if k != host_suffix.KEEP for w in b.split()] for p, v in parsed.items() if v[0] == host}
        hidden = brute_covered(streams, shortest)[page] if undecided else set()
        at, kept = 0, []
        for k, b in zip(kinds, blocks):
            if k == host_suffix.KEEP:
                kept.append(b)
                continue
            n = 1 + sum(b in v[2] for v in others)
            outside = any(k2 == host_suffix.DROP and b2 == b for v in [*others, (host, kinds, blocks, undecided)] for k2, b2 in zip(v[1], v[2]))
            copied = n > 1 and not outside and n <= max(2, (len(others) + 1) * copies)
            words = b.split()
            left = words if copied else [w for j, w in enumerate(words, at) if j not in hidden]
            at += len(words)
            if k == host_suffix.OPEN and left:
                kept.append(" ".join(left))
        out[page] = ("\n".join(kept), len(hidden))
    return [(p[0], *out[p]) for p in pages]


def test_pages_equal_brute_force(spark):
    rng = random.Random(31)
    lines = [" ".join(rng.choice("abcd") + rng.choice("xy") for _ in range(rng.choice([2, 9, 20, 70]))) for _ in range(14)]
    pages = []
    for k in range(60):
        inner = "".join(f"<{t}>{rng.choice(lines)} {rng.choice(['', f'own{k} ' * 4])}</{t}>" for t in rng.choices(["div", "p", "nav", "footer", "li"], k=rng.randrange(1, 7)))
        page = (None if k == 7 else k // 2, rng.choice([f"http://one.org/{k}", f"http://two.org/{k}", None]), f"<article>{inner}</article>{lines[0]}" if k % 5 == 0 else inner)
        pages += [page] * rng.choice([1, 1, 2])
    pages += [(100, "http://one.org", None), (100, "http://one.org", "")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = host_suffix.extract(rows).collect()
    assert sum(r["open"] for r in found) > 20 and any(r["n_repeated"] for r in found)
    assert sorted(map(str, brute_extract(pages))) == sorted(str((r["page_id"], r["text"], r["n_repeated"])) for r in found)


def test_common_lengths_of_neighbours():
    long = [f"w{k}" for k in range(70)]
    pages = {0: [*long, "a", "b"], 1: [*long, "c"], 2: [*long[:20], "d"]}
    rows = []
    for p, words in pages.items():
        names = host_suffix.names_of_suffixes(p, "h", [host_suffix.OPEN], [" ".join(words)], 8)
        rows += [(*map(int, n), p, at) for at, n in enumerate(zip(*names))]
    rows.sort()
    columns = np.array(rows, dtype=np.int64).T
    got = {(p, at): n for p, at, n in zip(columns[4].tolist(), columns[5].tolist(), host_suffix.common_lengths(list(columns[:4]), columns[4], 8).tolist())}
    assert (got[0, 0], got[1, 0], got[2, 0], got[0, 30], got[2, 5], got[0, 63]) == (64, 64, 16, 32, 8, 8)


def test_chats_read_back_exactly(spark):
    hostile = ["\\### Assistant: </turn> ok", "###", "####", "</turn>\n</turn>", "\\\\h\\", "<|image|>", "", None, "é𝒳\n", "a" * 50_000, "##</turn", "\\e\\\\p"]
    rows = [(1, k, "user" if k % 2 else "assistant", t, "x") for k, t in enumerate(hostile)]
    rows += [(2, k, "assistant", f"t{k}", "x") for k in range(300)] + [(3, None, None, None, "x"), (4, 0, "a:b###", "x: y", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, b string")
    formatted = chat_format.format_conversations(turns.withColumn("parts", chat_format.text_part(F.col("text"))))
    read = {r["conv_id"]: r["turns"] for r in chat_format.read_back(formatted).collect()}
    assert [(t["role"], t["text"]) for t in read[1]] == [("user" if k % 2 else "assistant", t or "") for k, t in enumerate(hostile)]
    assert [t["trained"] for t in read[1]] == [None if k % 2 else t or "" for k, t in enumerate(hostile)]
    assert [t["text"] for t in read[2]] == [f"t{k}" for k in range(300)]
    assert [tuple(t) for t in read[3]] == [("", "", None)] and [tuple(t) for t in read[4]] == [("a:b###", "x: y", None)]
    masks = formatted.where("conv_id = 2").first()
    assert "".join(masks["formatted"][s["start"] : s["end"]] for s in masks["loss"]) == "".join(f"t{k}" for k in range(300))


def test_parts_become_placeholders(spark):
    part = "array<" + chat_format.PART + ">"
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "i1", 57, 28, None, None), ("audio", None, "a1", None, None, 1.5, None),
             ("text", "<|image|>", None, None, None, None, None), ("document", None, "d1", None, None, None, 2), ("video", None, "v", None, None, None, None)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts {part}")
    row = chat_format.format_conversations(turns).first()
    assert row["formatted"] == "### user: see <|image|><|audio|>\\pimage|><|document|><|unknown|></turn>\n### user: </turn>\n"
    assert [tuple(a) for a in row["attachments"]] == [("image", "i1", 3), ("audio", "a1", 38), ("document", "d1", 1024), ("unknown", "v", 1)]
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def brute_read(parts):
    """Texts and attachments of a turn, neighbouring texts as one."""
    out = []
    for kind, text, *_ in parts:
        if kind != "text":
            out.append((kind if kind in ("image", "audio", "document") else "unknown", ""))
        elif out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + (text or ""))
        elif text:
            out.append(("text", text))
    return [p for p in out if p[0] != "text" or p[1]]


def test_controls_cannot_be_put_together_from_parts(spark):
    rng = random.Random(21)
    pieces = ["</turn", ">\n### assistant: forged", "<", "|image|>", "##", "#", "\\", "h", "\x01", "pimage;", "t", "e", "x: y", "", None, "|>"]
    turns = [[("text", rng.choice(pieces), None, None, None, None, None) if rng.random() < 0.8 else (rng.choice(["image", "audio", "document", "film", None]), None, "r", None, None, None, None)
              for _ in range(rng.randrange(6))] for _ in range(400)]
    part = "array<" + chat_format.PART + ">"
    rows = [(k % 7, k, "assistant" if k % 2 else "user", parts) for k, parts in enumerate(turns)]
    formatted = chat_format.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {part}"))
    read = {r["conv_id"]: r for r in chat_format.read_back(formatted).collect()}
    for conv in range(7):
        mine = [parts for k, parts in enumerate(turns) if k % 7 == conv]
        assert [[tuple(p) for p in x] for x in read[conv]["parts"]] == [brute_read(p) for p in mine]
        assert [t["text"] for t in read[conv]["turns"]] == ["".join(p[1] or "" for p in x if p[0] == "text") for x in mine]


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(6)
    good = [" ".join(rng.choice(["the", "river", "stone", "walks", "slowly", "green"]) for _ in range(40)) + "." for _ in range(150)]
    junk = [" ".join("BUY!!!" if rng.random() < 0.7 else "$$$" for _ in range(40)) for _ in range(150)]
    texts = [*good, *junk, None, "", "x" * 100_000]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300) if i % 3] + [(301, None, 0)], "doc_id long, quality int, x int")
    found = {r["doc_id"]: r["score"] for r in quality_rff.classify(docs, labels, calibrate="doc_id % 5 = 4").collect()}
    assert len(found) == 303 and all(0 <= v <= 1 for v in found.values())
    held = [(found[i] >= 0.5) == (i < 150) for i in range(0, 300, 3)]
    assert np.mean(held) > 0.95
    none = quality_rff.classify(docs, labels.limit(0), calibrate="true").select("score").distinct().collect()
    assert [r[0] for r in none] == [0.5]


def test_pooled_means_rise():
    assert quality_rff.pooled(np.array([1.0, 0, 2, 1]), np.array([1.0, 1, 2, 2])).tolist() == [0.5, 0.5, 0.75, 0.75]


def test_languages_and_spans(spark):
    samples = {"en": "the quick thing with other weather nothing", "de": "schön nicht auch zwischen würde machen", "ru": "это слово язык погода время"}
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choices(samples[lang].split(), k=20)), lang) for k, lang in enumerate(list(samples) * 30)]
    counts = language_id.train(spark.createDataFrame([*rows, (999, None, "en"), (998, "x", None)], "doc_id long, text string, lang string"))
    assert sorted(counts) == ["de", "en", "ru"]
    mixed = "the quick weather nothing other thing with. nicht schön würde machen zwischen auch nicht"
    texts = [mixed, "слово погода", None, "123 ...", "", "the " * 20_000]
    found = {r["doc_id"]: r for r in language_id.identify(docs_of(spark, texts), counts).collect()}
    assert [(s["lang"], mixed[s["start"] : s["end"]]) for s in found[0]["spans"]] == [("en", mixed[:42]), ("de", mixed[44:])]
    assert [found[k]["lang_pred"] for k in range(1, 6)] == ["ru", "und", "und", "und", "en"] and found[2]["score"] == 0
    kept = language_id.identify(docs_of(spark, texts), counts, carry=True).select("row.*")
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs_of(spark, texts).collect()))
    assert language_id.identify(docs_of(spark, ["x"]), {}).first()["lang_pred"] == "und"


def test_viterbi_equals_all_paths():
    from itertools import product

    rng = np.random.default_rng(8)
    texts = [rng.normal(size=(n, 3)).astype(np.float32) * 2 for n in (1, 5, 6, 0)]
    for scores, path in zip(texts, language_id.viterbi(texts, 1.5)):
        def value(p, s=scores):
            return sum(s[k, x] for k, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))

        best = max(map(value, product(range(3), repeat=len(scores))))
        assert value(path.tolist()) == pytest.approx(best, abs=1e-4)


def test_one_valid_instance_of_a_shape_is_enough(spark):
    seeds = spark.createDataFrame([("card", "9999", "card", "ok")] * 9, "kind string, shape string, left string, right string")
    for kinds in ([[], ["card"]], [["card"], []]):
        rows = [(k, "9999", "card", "ok") for k in kinds]
        some = spark.createDataFrame(rows, "kinds array<string>, shape string, left string, right string").coalesce(1)
        assert [(r["kind"], r["n"]) for r in pii_bootstrap.score(seeds, some, 1, 5).collect()] == [("card", 1)]


def test_identifiers_of_many_tokens_are_whole_instances(spark):
    texts = ["ring 01 23 45 67 89 now", "1 2 3 4 5 6 7 8 9"]
    runs = pii_bootstrap.candidates_of(pii_bootstrap.scan(docs_of(spark, texts), "doc_id", "text"), 4).collect()
    found = [(r["id"], r["start"], r["end"], r["left"], r["right"]) for r in runs if "phone" in r["kinds"]]
    assert (0, 5, 19, "ring", "now") in found and (1, 0, 17, "", "") in found


def test_token_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_file())
    model.encode_special_tokens = True
    ours = packing_nnls.Encoder(tokenizer_file())
    for text in ["", " ", "a  b ", "\n\n x\t'll I'm 12three ***", "é𝒳 ñ", "<|endoftext|> x", "\0 a", "x" * 3000]:
        assert ours.encode(text).tolist() == model.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_one_id_as_in_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_file())
    texts = ["see <|endoftext|> here", "<|endoftext|>", "a  <|endoftext|>\n<|endoftext|>b", "<|endoftext", "plain  text "]
    want = [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [3826, 220, 50256, 994]
    ours = packing_nnls.Encoder(tokenizer_file())
    assert [ours.encode_added(t).tolist() for t in texts] == want
    rows = packing_nnls.pack(docs_of(spark, texts), tokenizer_file()).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in rows} == {i: zlib.crc32(np.array([*w, 1], dtype="<u4").tobytes()) for i, w in enumerate(want)}


def test_packing_is_exact(spark):
    rng = random.Random(9)
    texts = [None, "", "a"] + ["same text"] * 300 + [" ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randrange(1, 900))) for _ in range(200)] + ["x y " * 6000]
    rows = packing_nnls.pack(docs_of(spark, texts), tokenizer_file(), rows_per_salt=50).collect()
    ours = packing_nnls.Encoder(tokenizer_file())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = np.append(ours.encode(t or ""), 1).astype("<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    used = sum(n for p in sequences.values() for _, n in p)
    assert used / (2048 * len(sequences)) > 0.95  # 300 pieces of three tokens take a bin of eight each
    assert packing_nnls.pack(docs_of(spark, ["x"]).limit(0), tokenizer_file()).count() == 0


def test_plans_use_every_piece():
    rng = np.random.default_rng(10)
    for counts in (rng.integers(0, 500, 65), np.r_[np.zeros(40, int), np.full(24, 9), 0], np.r_[0, 1000, np.zeros(63, int)], np.zeros(65, int)):
        counts = counts.copy()
        counts[0] = counts[64] = 0
        used = np.zeros(65, dtype=int)
        for repeats, parts in packing_nnls.plan_windows(counts):
            assert sum(k * m for k, m in parts.items()) <= 64
            for k, m in parts.items():
                used[k] += repeats * m
        assert (used == counts).all()


def test_short_pieces_take_their_own_length(spark):
    rows = packing_nnls.pack(docs_of(spark, [None] * 5000 + ["a"] * 1000), tokenizer_file()).collect()
    room = defaultdict(int)
    for r in rows:
        room[r["sequence_id"]] += r["length"]
    assert len(rows) == 6000 and max(room.values()) <= 2048 and len(room) == -(-7000 // 2048)


def test_coarse_plans_use_every_piece_by_its_size():
    rng = np.random.default_rng(11)
    counts = rng.integers(0, 300, 2049)
    counts[np.arange(2049) % 8 > 0] *= np.arange(2049)[np.arange(2049) % 8 > 0] < 64
    counts[0] = counts[2048] = 0
    plan, used = packing_nnls.plan_windows(counts, 8), np.zeros(2049, dtype=int)
    for repeats, parts in plan:
        assert sum(k * m for k, m in parts.items()) <= 2048
        for k, m in parts.items():
            used[k] += repeats * m
    assert (used == counts).all()
    ideal = (counts * np.arange(2049)).sum() / 2048
    assert sum(n for n, _ in plan) < 1.03 * ideal


def test_pipeline_stages_keep_the_columns_and_do_their_work(spark, data):
    import corpus_pipeline as pipeline

    raw = spark.read.parquet(f"{data}/documents.parquet")
    extra = [(90_001, "!!! 123", None, "s", 7), (90_002, None, None, "s", 0)]
    docs = raw.unionAll(spark.createDataFrame(extra, raw.schema))
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, data), name)
        assert docs.columns == raw.columns
        kept[name] = {r[0] for r in docs.select("doc_id").collect()}
    whole = {r["doc_id"]: r["text"] for r in raw.collect()}
    assert kept["language"] == {i for i, t in whole.items() if any(c.isalpha() for c in t or "")}
    classes = QUERIES["op3_ngram_jaccard_join"](spark, data).where("doc_id = class_id")
    assert kept["near_duplicates"] == {r[0] for r in classes.collect()} & kept["language"]
    clean = QUERIES["op6_benchmark_decontamination"](spark, data).where("not contaminated")
    assert kept["decontamination"] == kept["near_duplicates"] & {r[0] for r in clean.collect()}
    assert kept["personal_data"] == kept["decontamination"]
    assert all(not plain_spans(r["text"]) for r in docs.collect())
    packed = pipeline.packing(spark, docs, data)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == kept["personal_data"]


def test_a_text_with_thousands_of_spans_is_redacted_whole(spark):
    from tidegauge.llm import pii_bootstrap

    text = "é " + " ".join(f"user{k}@ex{k % 7}.org wrote to +33 6 {k % 90 + 10} 34 56 78, ok" for k in range(1500))
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string")
    found = pii_bootstrap.extract(docs)
    spans = {r["doc_id"]: r["spans"] for r in found.collect()}
    assert len(spans[1]) == 3000
    out, at = [], 0
    for x in sorted(spans[1], key=lambda x: (x["start"], x["end"], x["kind"])):
        if x["start"] >= at:
            out += [text[at : x["start"]], f"[{pii_bootstrap.KINDS[x['kind']].upper()}]"]
        at = max(at, x["end"])
    clean = {r["doc_id"]: r["text"] for r in pii_bootstrap.redact(docs, found).collect()}
    assert clean == {1: "".join(out) + text[at:], 2: "none", 3: None}


def long_conversation(spark, n, one_number):
    turns = spark.range(n).select(
        F.lit(1).alias("conv_id"), F.lit(5).alias("turn") if one_number else F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.format_string("said %07d ### </turn>", "id").alias("text"),
    )
    return turns.withColumn("parts", chat_format.text_part(F.col("text")))


@pytest.mark.parametrize("one_number", [False, True])
def test_long_conversations_take_linear_time_and_read_back(spark, one_number):
    import time

    def seconds(n):
        began = time.perf_counter()
        read = chat_format.read_back(chat_format.format_conversations(long_conversation(spark, n, one_number)))
        row = read.select(F.size("turns"), F.xxhash64("turns"), F.size(F.filter("turns", lambda t: t["trained"].isNotNull())), F.element_at("turns", -1)).first()
        took = time.perf_counter() - began
        assert row[0] == n and row[2] == n // 2
        assert row[3]["text"] == f"said {n - 1 if one_number is False else n - 2:07d} ### </turn>"
        return took

    seconds(500)
    few, many = seconds(16_000), seconds(64_000)
    assert many < 5 * max(few, 1.0)


def test_turns_of_one_number_keep_their_order(spark):
    rng = random.Random(7)
    rows = [(k % 3, rng.choice([None, 1, 1, 1, 2]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None]) if k % 2 else f"t{rng.randrange(90)}") for k in range(900)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("parts", chat_format.text_part(F.col("text")))
    found = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.read_back(chat_format.format_conversations(turns, block=16)).collect()}
    for c in range(3):
        mine = sorted((-1 if t is None else t, r or "", x or "") for i, t, r, x in rows if i == c)
        assert found[c] == [(r, x) for _, r, x in mine]


def test_names_inside_an_article_drop_text_only_if_they_say_nothing_else(spark):
    kept = {"social-history": "div", "search-and-rescue": "section", "notice-board": "p", "privacy_law": "div", "comments-on-hegel": "div", "free-share": "p"}
    dropped = {"ad": "div", "ad-slot": "div", "related-posts": "section", "comment_list": "ul", "share-buttons": "div", "newsletter signup": "div"}
    body = "".join(f'<{tag} class="{name}">text of {name}.</{tag}>' for name, tag in {**kept, **dropped}.items())
    rows = [(1, "http://a.org/1", f"<body><article><p>One.</p>{body}</article><div class='social-history'>outside</div></body>")]
    found = host_suffix.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).first()["text"]
    assert found.split("\n") == ["One.", *(f"text of {name}." for name in kept)]


@pytest.fixture(scope="module")
def awkward_folder(spark, data, tmp_path_factory):
    """The given documents and labels with null ids, null and empty texts, repeated rows and a clashing column; and both tables empty."""
    top = tmp_path_factory.mktemp("awkward")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    more = spark.createDataFrame([(None, "one text without an id", "en", "s", 1), (None, None, None, None, None), (4_000_001, "", None, "s", 0), (4_000_002, None, "de", "s", 0)], docs.schema)
    more = more.unionAll(docs.limit(30)).unionAll(docs.limit(3))
    docs.unionAll(more).withColumn("score", F.lit("clash")).withColumn("id", F.lit(0)).write.parquet(f"{top}/full/documents.parquet")
    labels.write.parquet(f"{top}/full/labels.parquet")
    docs.limit(0).write.parquet(f"{top}/empty/documents.parquet")
    labels.write.parquet(f"{top}/empty/labels.parquet")
    return str(top), docs.count() + more.count()


@pytest.mark.parametrize(("name", "divisor", "remainder"), [("op8_quality_classifier", 5, 0), ("op9_language_id", 4, 2)])
def test_learned_queries_on_awkward_tables(spark, data, awkward_folder, name, divisor, remainder):
    folder, n = awkward_folder
    rows = QUERIES[name](spark, f"{folder}/full").collect()
    assert len(rows) == n and all(isinstance(r["held_out"], bool) and 0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % divisor == remainder)
    seen = defaultdict(set)
    for r in rows:
        if r["doc_id"] is not None:
            seen[r["doc_id"]].add(tuple(r))
    assert all(len(x) == 1 for x in seen.values())  # repeated rows are decided alike
    if name == "op9_language_id":
        assert {r["lang_pred"] for r in rows if r["doc_id"] in (4_000_001, 4_000_002)} == {"und"}
        assert QUERIES[name](spark, f"{folder}/empty").count() == 0
    else:
        assert QUERIES[name](spark, f"{folder}/empty").count() == 0
