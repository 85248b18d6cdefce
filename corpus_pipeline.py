"""Documents to packed training sequences: language, near copies, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents;
the last returns pieces in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import common, contamination, jaccard, langid, packing, substring_dedup, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Most ids that a stage's list of dropped documents may have to be sent to every task; a longer list is joined by shuffle.
SENT_IDS = 2_000_000


def keyed(docs: DataFrame) -> DataFrame:
    """With a hash of the text, since rows of one id may hold several texts."""
    return docs.withColumn("text_key", F.xxhash64("text"))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Documents that are not in ``dropped`` by id and text; rows without an id stay."""
    dropped = common.stored(dropped.select("doc_id", "text_key").where("doc_id IS NOT NULL").distinct(), "dropped")
    if dropped.limit(SENT_IDS + 1).count() <= SENT_IDS:
        dropped = F.broadcast(dropped)
    return keyed(docs).join(dropped, ["doc_id", "text_key"], "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the predicted language into ``lang``; documents without one (null or empty text, or no letter) go.

    Repeated rows, equal ids and null ids are judged row by row. An empty table gives an empty one.
    """
    found = langid.identify(docs, langid.learned(docs), carry=["source", "n_chars"], keep_text=True)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of similar ones.

    Rows that repeat both id and text are one document: the row with the least language, source and length stays. Rows
    of one id with different texts are judged apart. Texts without a word are similar to none and stay, as do null ids.
    """
    found = jaccard.jaccard_components(keyed(docs), carry=["text_key"])
    kept = without(docs, found.where("doc_id <> component_id"))
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    return kept.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "text", *[F.col("row")[c].alias(c) for c in rest]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of the texts; every row stays, also one whose text becomes empty. A null text becomes empty."""
    found = substring_dedup.remove_repeats(docs, carry=["lang", "source"])
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule marks go, by id and text; empty texts are never marked, rows without an id stay."""
    found = contamination.decontaminate(keyed(docs), common.documents(spark, sf_dir, "benchmark"), carry=["text_key"])
    return without(docs, found.where("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of at most 4096 tokens; an empty text is its end id alone."""
    return packing.pack(docs, tokens.default_path())


STAGES = [
    ("language", language), ("near_copies", near_copies), ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages), ("packing", packed),
]
#: The first and the last stage are no SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
