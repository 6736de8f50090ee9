"""The corpus pipeline: five stages from raw documents to packed token sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``. ``run`` writes each stage's result to the
shared folder as Parquet and reads it back as the next stage's documents.

Nulls in any column, repeated rows, empty and very long texts and further
columns of any name pass through; each stage says what it does with them. An
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import chosen_path, decontaminate, language_id, packing_nnls, pii_bootstrap
from tidegauge.llm.common import materialize, table
from tidegauge.llm.queries import held_out, tokenizer_file

#: Subword segmentation has no SQL form, so the pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (null, or no letter at all); fill missing labels with the prediction.

    Every row is decided by its own text; repeated rows and null ids are rows like any other.
    """
    counts = language_id.train(docs.where(~held_out(4, 2)))
    found = language_id.identify(docs, counts, carry=True).where("lang_pred != 'und'")
    label = F.coalesce(F.col("row.lang"), F.col("lang_pred"))
    return found.withColumn("row", F.col("row").withField("lang", label)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each class of five-gram Jaccard links at 0.8 and above.

    Of repeated rows (one id and text) one stays. Rows without an id are known by their text, and stay only if
    no row with an id is alike. Rows of one id with different texts are one document: they stay or go together.
    """
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    known = F.coalesce(docs["doc_id"].cast("long"), F.lit(1 << 62) + F.pmod(key, F.lit(1 << 61)))
    named = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), known.alias("id"), key.alias("key"))
    classes = chosen_path.similarity_join(named.select("id", F.col("row.text").alias("text")), id_col="id")
    # Decided on ids alone, and stored, so that Spark knows their size when it plans the joins: below its threshold no text is shuffled.
    marks = classes.groupBy("id").agg(F.max(F.col("id") != F.col("class_id")).alias("gone"), (F.count("*") > 1).alias("again"))
    marks = materialize(marks.where("gone or again"), "marks")
    plain = named.join(marks.select("id"), "id", "left_anti")
    repeated = named.join(marks.where("again and not gone").select("id"), "id", "left_semi").dropDuplicates(["id", "key"])
    return plain.select("row.*").unionAll(repeated.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item, or all words of a shorter one.

    A null or empty text holds none and stays. Every row is decided by its own text.
    """
    hits = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return hits.where("n_hit = 0").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the text by its kind; no document goes. A null text stays null; null ids are cleaned, too."""
    found = pii_bootstrap.extract(docs)
    clean = pii_bootstrap.redact(docs, found)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 2048: one row per piece of a document; a null text is one piece, the closing id."""
    return packing_nnls.pack(docs, tokenizer_file())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
