"""Operator 2: personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the validated matches of four fixed patterns. Every seed and every
other identifier-like token run of the corpus is an instance with lexical
patterns: its shape (digits to 9, letter runs to a), the word to its left and
the word to its right. The bipartite graph of instances and patterns is scored
in rounds. A pattern counts for a kind once enough instances support it, seeds
or instances promoted in earlier rounds, and once its confidence, the scored
share of its instances, is high; so promoted instances induce patterns that no
seed has. An unlabelled instance takes the noisy-or of such patterns. Instances
above the acceptance level that also satisfy the kind's digit rules are new
spans. Identical instances are counted before any shuffle, so a common word or
shape is one row. Scores are whole millionths and sums of whole numbers, so the
order of rows changes nothing.

Null and empty texts have no spans. Rows that share id and text get the same
spans; a null id is an id like any other. Very long texts are scanned whole, in
time that grows with their length. Without seeds nothing is added. New spans
never overlap seeds, and of overlapping new spans of a kind the first, then the
longest stays. An empty table gives an empty result. Extra columns are ignored,
and kept by ``redact``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import join_unique, materialize

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns, possessive where the following character decides, so that no run is scanned twice.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Runs of tokens that hold a digit or an @, one space apart.
ZONE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+"
#: What an instance outside the seeds must look like to be of a kind.
LOOSE = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+$",
    "ip": r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$",
    "card": r"^[0-9][0-9 -]+[0-9]$",
    "phone": r"^[+(]?[0-9][0-9 ().-]+[0-9]$",
}
#: Digits of the longest identifier with spaces; every token of a zone that may be part of one holds a digit.
MOST_DIGITS = 19
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum: from the right, every second digit doubled."""

    def add(total: Column, at: Column) -> Column:
        d = F.substring(digits, F.length(digits) - at, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(at % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, body: Column) -> Column:
    """The kind's rules on parts, digits and check sum."""
    digits = F.regexp_replace(body, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return body.rlike(OCTETS)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)


def word_before(gap: Column) -> Column:
    return F.lower(F.element_at(F.split(F.rtrim(F.right(gap, F.lit(40))), r"\s+"), -1))


def word_after(gap: Column) -> Column:
    return F.lower(F.element_at(F.split(F.ltrim(F.left(gap, F.lit(40))), r"\s+"), 1))


def shape(body: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(body, "[0-9]", "9"), "[A-Za-z]+", "a")


def starts_of(sizes: Column, block: int = 512, *, add=lambda a, b: a + b) -> Column:
    """Sums of all earlier entries of an array<int>, at every entry: in blocks, since arrays are copied when they grow."""

    def step(state: Column, x: Column) -> Column:
        return F.struct(add(state["at"], x).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    def plain(x: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, none, step)

    blocks = F.transform(F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(block)), lambda k: plain(F.slice(sizes, k + 1, block)))
    firsts = plain(F.transform(blocks, lambda b: b["at"]))["out"]
    whole = F.flatten(F.zip_with(blocks, firsts, lambda b, first: F.transform(b["out"], lambda x: add(x, first))))
    return F.when(F.size(sizes) > 0, whole).otherwise(F.array().cast("array<int>"))


def located(found: str, gaps: str) -> Column:
    """array<struct(start, end, body, left, right)> from a pattern's matches and the text between them."""
    sizes = F.transform(found, lambda body, k: F.length(F.get(F.col(gaps), k)) + F.length(body))
    firsts = F.zip_with(found, starts_of(sizes), lambda body, at: F.struct(body.alias("body"), at.alias("at")))

    def one(x: Column, k: Column) -> Column:
        before, after = F.get(F.col(gaps), k), F.get(F.col(gaps), k + 1)
        start = x["at"] + F.length(before)
        return F.struct(
            start.alias("start"),
            (start + F.length(x["body"])).alias("end"),
            x["body"].alias("body"),
            F.coalesce(word_before(before), F.lit("")).alias("left"),
            F.coalesce(word_after(after), F.lit("")).alias("right"),
        )

    none = F.array().cast("array<struct<start:int,end:int,body:string,left:string,right:string>>")
    return F.when(F.size(found) > 0, F.transform(firsts, one)).otherwise(none)


BLOCKS = "array<struct<lo:int,hi:int,s:array<struct<a:int,b:int>>>>"


def blocked(spans: str, block: int = 64) -> Column:
    """Spans (a, b) in order of a, in blocks with the range that each covers."""

    def one(k: Column) -> Column:
        part = F.slice(F.col(spans), k + 1, block)
        return F.struct(F.get(part, F.lit(0))["a"].alias("lo"), F.array_max(F.transform(part, lambda x: x["b"])).alias("hi"), part.alias("s"))

    some = F.transform(F.sequence(F.lit(0), F.size(spans) - 1, F.lit(block)), one)
    return F.when(F.size(spans) > 0, some).otherwise(F.array().cast(BLOCKS))


def meeting(blocks: str, lo: Column, hi: Column) -> Column:
    """Blocks of spans, with only those that overlap [lo, hi)."""

    def trimmed(b: Column) -> Column:
        return b.withField("s", F.filter(b["s"], lambda x: (x["b"] > lo) & (x["a"] < hi)))

    return F.transform(F.filter(blocks, lambda b: (b["hi"] > lo) & (b["lo"] < hi)), trimmed)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, key (hash of the text), seeds of all kinds, zones and the seeds' places in blocks, without the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    hints = {"email": F.instr("text", "@") > 0, "phone": F.instr("text", "+") > 0}
    for name, pattern in {**PATTERNS, "zone": ZONE}.items():
        some = hints.get(name, F.lit(True))
        out = out.withColumn(f"{name}_found", F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
        out = out.withColumn(f"{name}_gaps", F.when(F.size(f"{name}_found") > 0, F.split("text", pattern, -1)))
    found = [*PATTERNS, "zone"]
    out = out.select("id", "key", *(located(f"{k}_found", f"{k}_gaps").alias(k) for k in found))

    def kept(kind: str) -> Column:
        return F.filter(kind, lambda x: valid(kind, x["body"])).alias(kind)

    out = out.select("id", "key", *map(kept, KINDS), "zone")
    places = F.concat(*(F.transform(k, lambda x: F.named_struct(F.lit("a"), x["start"], F.lit("b"), x["end"])) for k in KINDS))
    out = out.withColumn("places", F.array_sort(places))
    return out.withColumn("places", blocked("places"))


def seeds_of(scanned: DataFrame) -> DataFrame:
    """One row per seed: id, key, kind, start, end, shape, left, right."""

    def named(kind: str) -> Column:
        return F.transform(kind, lambda x: x.withField("kind", F.lit(kind)))

    rows = scanned.select("id", "key", F.explode(F.concat(*map(named, KINDS))).alias("x"))
    return rows.select("id", "key", "x.kind", "x.start", "x.end", shape(F.col("x.body")).alias("shape"), "x.left", "x.right")


def candidates_of(scanned: DataFrame, max_tokens: int) -> DataFrame:
    """Runs of tokens of a zone that do not overlap a seed, with the kinds that they may be.

    Runs of up to ``max_tokens`` tokens are instances whatever they are; longer ones only if they are of a kind.
    A zone, and then a token, carries the seeds near it and no others.
    """
    nearby = F.transform("zone", lambda z: F.struct(z.alias("z"), meeting("places", z["start"], z["end"]).alias("near")))
    zones = scanned.select("id", "key", F.explode(nearby).alias("q"))
    zones = zones.select(
        "id", "key", F.col("q.near").alias("near"), F.split("q.z.body", " ").alias("t"), F.col("q.z.start").alias("at"), "q.z.left", "q.z.right"
    )
    most = max(max_tokens, MOST_DIGITS)
    places = starts_of(F.transform("t", lambda x: F.length(x) + 1))

    def near(i: Column, start: Column) -> Column:
        first = F.col("at") + start
        found = meeting("near", first, first + F.length(F.array_join(F.slice("t", i + 1, most), " ")))
        return F.flatten(F.transform(found, lambda b: b["s"]))

    # What a token needs of its zone: the runs that start there, and one word on either side.
    views = F.zip_with(
        F.sequence(F.lit(0), F.size("t") - 1), places,
        lambda i, start: F.struct(
            start.alias("start"), F.slice("t", i + 1, most).alias("t"), F.when(i > 0, F.get(F.col("t"), i - 1)).alias("before"),
            F.get(F.col("t"), i + most).alias("after"), near(i, start).alias("seeds"),
        ),
    )
    tokens = zones.select("id", "key", "at", "left", "right", F.explode(views).alias("v")).withColumn("seeds", F.col("v.seeds"))
    runs = tokens.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("v.t"))))
    run = F.array_join(F.slice("v.t", F.lit(1), F.col("n")), " ")
    next_one = F.lower(F.coalesce(F.get(F.col("v.t"), F.col("n")), F.when(F.col("n") == most, F.col("v.after"))))
    runs = runs.select(
        "id", "key", "seeds", (F.col("at") + F.col("v.start")).alias("first"), "n", run.alias("run"),
        F.coalesce(F.lower("v.before"), F.col("left")).alias("left"), F.coalesce(next_one, F.col("right")).alias("right"),
    )
    lead = F.length(F.regexp_extract("run", r"^[^0-9A-Za-z+(]*", 0))
    body = F.regexp_replace(F.regexp_replace("run", r"^[^0-9A-Za-z+(]+", ""), r"[^0-9A-Za-z)]++$", "")
    runs = runs.select("id", "key", "seeds", "n", (F.col("first") + lead).alias("start"), body.alias("body"), "left", "right")
    runs = runs.withColumn("end", F.col("start") + F.length("body"))
    runs = runs.where(~F.exists("seeds", lambda s: (s["a"] < F.col("end")) & (s["b"] > F.col("start"))))
    kinds = F.filter(
        F.array(*(F.when(F.col("body").rlike(LOOSE[k]) & valid(k, F.col("body")), F.lit(k)) for k in KINDS)), lambda k: k.isNotNull()
    )
    runs = runs.withColumn("kinds", kinds).where((F.col("n") <= max_tokens) | (F.size("kinds") > 0))
    return runs.select("id", "key", "kinds", "start", "end", shape(F.col("body")).alias("shape"), "left", "right")


#: Scores are whole numbers of this size.
ONE = 1_000_000
VIEWS = ("shape", "left", "right")


def by_pattern(instances: DataFrame) -> DataFrame:
    """Instances once for each of their patterns: view (place in VIEWS) and value."""
    values = F.array(*(F.struct(F.lit(k).alias("view"), F.col(v).alias("value")) for k, v in enumerate(VIEWS)))
    return instances.withColumn("p", F.explode(values)).select("*", "p.view", "p.value").drop("p")


def score(seeds: DataFrame, candidates: DataFrame, rounds: int, support: int, accept: float = 0.75, trust: float = 0.5) -> DataFrame:
    """(shape, left, right, kind, n, score) of unlabelled instances after so many rounds over the graph.

    A pattern counts with ``support`` seeds or promoted instances (score at least ``accept``) and a confidence of ``trust``.
    """
    labelled = materialize(seeds.groupBy(*VIEWS, "kind").agg(F.count("*").alias("n")), "labelled")
    unknown = materialize(candidates.groupBy(*VIEWS).agg(F.count("*").alias("n")), "instances")
    # Digits decide the kinds, so instances of one shape may differ in them.
    open_kinds = candidates.select(*VIEWS, F.explode("kinds").alias("kind")).groupBy(*VIEWS, "kind").agg(F.count("*").alias("n"))
    scored = materialize(open_kinds.withColumn("points", F.lit(0).cast("long")), "open")
    totals = by_pattern(labelled.select(*VIEWS, "n").unionAll(unknown.select(*VIEWS, "n"))).groupBy("view", "value").agg(F.sum("n").alias("total"))
    sure = by_pattern(labelled).groupBy("view", "value", "kind").agg(F.sum("n").alias("sure"))
    totals, sure = materialize(totals, "totals"), materialize(sure, "sure")
    instance = [*VIEWS, "kind", "n"]
    for _ in range(rounds):
        edges = by_pattern(scored)
        won = edges.groupBy("view", "value", "kind").agg(
            F.sum(F.col("n") * F.col("points")).alias("likely"),
            F.sum(F.when(F.col("points") >= int(accept * ONE), F.col("n")).otherwise(0)).alias("promoted"),
        )
        known = won.join(sure, ["view", "value", "kind"], "left").na.fill(0, ["sure"]).where(F.col("sure") + F.col("promoted") >= support)
        known = known.join(totals, ["view", "value"])
        trusted = known.withColumn("by", F.floor((F.col("sure") * ONE + F.col("likely")) / (F.col("total") + 1)))
        trusted = trusted.where(F.col("by") >= int(trust * ONE)).select("view", "value", "kind", "by")
        best = edges.join(trusted, ["view", "value", "kind"]).groupBy(*instance).agg(
            *(F.max(F.when(F.col("view") == k, F.col("by"))).alias(f"by_{v}") for k, v in enumerate(VIEWS))
        )
        doubt = reduce(lambda a, b: a * b, (1 - F.coalesce(f"by_{v}", F.lit(0)) / ONE for v in VIEWS))
        found = best.select(*instance, F.round((1 - doubt) * ONE).cast("long").alias("won"))
        joined = scored.drop("points").join(found, instance, "left")
        scored = materialize(joined.select(*instance, F.coalesce("won", F.lit(0).cast("long")).alias("points")), "scores")
    return scored.select(*instance, (F.col("points") / ONE).alias("score"))


def apart(spans: Column) -> Column:
    """Of spans in order of kind and start, those that do not overlap an earlier kept one of their kind."""
    span = "struct<kind:int,start:int,neg:int,end:int>"

    def keep(kept: Column, x: Column) -> Column:
        clash = (kept["kind"] == x["kind"]) & (kept["end"] > x["start"])
        full = F.size(kept["open"]) >= 512  # in blocks, since arrays are copied when they grow
        done = F.when(full, F.concat(kept["done"], F.array(kept["open"]))).otherwise(kept["done"])
        grown = F.when(full, F.array(x)).otherwise(F.concat(kept["open"], F.array(x)))
        return F.when(clash, kept).otherwise(F.struct(done.alias("done"), grown.alias("open"), x["kind"].alias("kind"), x["end"].alias("end")))

    none = F.struct(
        F.array().cast(f"array<array<{span}>>").alias("done"), F.array().cast(f"array<{span}>").alias("open"), F.lit(-1).alias("kind"), F.lit(0).alias("end")
    )
    return F.aggregate(spans, none, keep, lambda kept: F.flatten(F.concat(kept["done"], F.array(kept["open"]))))


def extract(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 3,
    support: int = 5,
    accept: float = 0.75,
    trust: float = 0.5,
    max_tokens: int = 4,
) -> DataFrame:
    """Per row: id_col, key (xxhash64 of the text), base and spans: arrays of (kind, start, end), kind by place in KINDS."""
    scanned = materialize(scan(docs, id_col, text_col), "scanned")
    seeds = seeds_of(scanned)
    candidates = materialize(candidates_of(scanned, max_tokens), "candidates")
    scores = score(seeds, candidates, rounds, support, accept, trust).where(F.col("score") >= accept)
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    name = F.concat_ws("\n", *VIEWS, "kind").alias("instance")  # none of them holds a line feed
    wanted = candidates.where(F.size("kinds") > 0).withColumn("kind", F.explode("kinds"))
    wanted = wanted.select("id", "key", number.alias("kind"), "start", "end", name)
    new = join_unique(wanted, scores.select(name), "instance").select("id", "key", "kind", "start", "end").distinct()
    ordered = F.sort_array(F.collect_list(F.struct("kind", "start", (F.col("start") - F.col("end")).alias("neg"), "end")))
    new = new.groupBy("id", "key").agg(ordered.alias("new"))

    def numbered(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    base = F.concat(*map(numbered, KINDS))
    added = F.transform(apart(F.col("new")), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    new = new.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "new")
    rows = scanned.select("id", "key", base.alias("base"))
    joined = rows.join(new, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    spans = F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", added)))
    return joined.select(F.col("id").alias(id_col), "key", "base", spans.alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span's text replaced by its kind in brackets; overlapping spans become one, named by the first."""
    spans = found.select(F.col(id_col).alias("_of"), F.col("key").alias("_text"), F.col("spans").alias("_spans")).where(F.size("spans") > 0)
    spans = spans.dropDuplicates(["_of", "_text"])  # rows of one id and text have equal spans
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    keyed = docs.select(row, docs[id_col].cast("long").alias("_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("_key"))
    same = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_text"))
    order = F.array_sort(F.transform("_spans", lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("k"))))
    joined = keyed.join(spans, same, "left").select("row", order.alias("x"))

    name = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    joined = joined.withColumn("ends", F.transform("x", lambda x: x["e"]))
    joined = joined.withColumn("end", starts_of(F.col("ends"), add=F.greatest))  # how far the spans before each one reach
    # In blocks, since every cut walks the text from its start.
    size = 128

    def chunk(k: Column) -> Column:
        mine, reached = F.slice("x", k + 1, size), F.slice("end", k + 1, size)
        lo = F.get(F.col("end"), k)
        hi = F.greatest(lo, F.array_max(F.slice("ends", k + 1, size)))
        return F.struct(mine.alias("x"), reached.alias("end"), lo.alias("lo"), F.substring(text, lo + 1, hi - lo).alias("text"))

    def clear(c: Column) -> Column:
        def piece(x: Column, end: Column) -> Column:
            kept = F.substring(c["text"], end - c["lo"] + 1, x["s"] - end)
            return F.when(x["s"] >= end, F.concat(kept, F.get(name, x["k"]))).otherwise("")

        return F.array_join(F.zip_with(c["x"], c["end"], piece), "")

    chunks = F.transform(F.sequence(F.lit(0), F.size("x") - 1, F.lit(size)), chunk)
    pieces = F.when(F.size("x") > 0, F.transform(chunks, clear))
    tail = F.substring(text, F.array_max("ends") + 1, F.length(text))
    clean = F.when(F.col("x").isNull(), F.col("row").getField(text_col)).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return joined.select(F.col("row").withField(f"`{text_col}`", clean).alias("row")).select("row.*")
