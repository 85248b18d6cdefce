"""Document steps: entities, volatility, chunks, cards, ids and ingest."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.config import RETRIEVAL, Retrieval
from tracemill.functions import text
from tracemill.operators.skew import latest_per, small_side

WORD = "[A-Z][a-z]+"


def entity_rows(docs: DataFrame, key: str, body: str, gazetteer: DataFrame, candidate: str = WORD,
                max_chars: int | None = None) -> DataFrame:
    """(key, name, label): candidates found in the text that a gazetteer (name, label) knows, each once.

    Repeats are removed inside the row before the join, so a name that is in
    every document costs one row per document. The gazetteer is broadcast only
    when it is counted to be small.
    """
    source = F.substring(body, 1, max_chars) if max_chars else F.col(body)
    names = F.array_distinct(F.transform(
        F.regexp_extract_all(source, F.lit(candidate), F.lit(0)), lambda w: F.lower(F.trim(w))
    ))
    known = small_side(gazetteer.where(F.col("label").isin(*text.ENTITY_LABELS)).select("name", "label").distinct())
    return docs.select(key, F.explode(names).alias("name")).join(known, "name").select(key, "name", "label")


#: A word of any script, or a mark that ends a clause; names hold the same tokens, so none reaches over such a mark unseen.
TOKEN = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*|[.!?;:,\n]"


def tokens(body: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(TOKEN), F.lit(0))


def named_spans(docs: DataFrame, key: str, body: str, gazetteer: DataFrame, capital: bool = True) -> DataFrame:
    """(key, name, label, start, length): places, in tokens, of names of one or more words, in any case of letters.

    A name found inside a longer one is left out (``Reserve`` in ``Federal Reserve``); names that only overlap both
    stay. With ``capital`` a place begins with an upper-case letter. A text is cut once into tokens; only word runs as
    long as some name leave it, so no text is shuffled. The gazetteer (name, label) is broadcast only when it is counted
    to be small; a name may have several labels. Null texts and names without a word have no place; an empty gazetteer finds nothing.
    """
    known = gazetteer.where(F.col("label").isin(*text.ENTITY_LABELS)).select(tokens(F.col("name")).alias("_t"), "label").where(F.size("_t") > 0)
    known = known.groupBy(F.lower(F.array_join("_t", " ")).alias("name"), F.size("_t").alias("length")).agg(F.collect_set("label").alias("labels"))
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())  # as many as there are lengths of names
    if not lengths:
        return docs.select(key, *[F.lit(None).cast(t).alias(n) for n, t in (("name", "string"), ("label", "string"), ("start", "int"), ("length", "int"))]).limit(0)

    def runs(found: Column) -> Column:
        places = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
        begins = F.filter(places, lambda i: F.get(found, i).rlike(r"^\p{Lu}" if capital else r"^[\p{L}\p{N}]"))
        return F.flatten(F.transform(begins, lambda i: F.filter(
            F.array(*[F.struct(i.alias("start"), F.lit(n).alias("length"), F.lower(F.array_join(F.slice(found, i + 1, n), " ")).alias("name")) for n in lengths]),
            lambda run: i + run["length"] <= F.size(found),
        )))

    spans = docs.select(key, F.explode(text.bind(tokens(F.col(body)), runs)).alias("_r")).select(key, "_r.*")
    hits = spans.join(small_side(known), ["name", "length"])
    before = Window.partitionBy(key).orderBy("start", F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    outer = hits.withColumn("_end", F.max(end).over(before)).where(F.col("_end").isNull() | (F.col("_end") < end))
    return outer.select(key, "name", F.explode("labels").alias("label"), "start", "length")


def phrase_rows(docs: DataFrame, key: str, body: str, gazetteer: DataFrame, capital: bool = True) -> DataFrame:
    """(key, name, label) of :func:`named_spans`, each once: the finder of :func:`with_entities` for names of several words."""
    return named_spans(docs, key, body, gazetteer, capital).select(key, "name", "label").distinct()


def with_entities(docs: DataFrame, key: str, body: str, gazetteer: DataFrame, find=entity_rows, **options) -> DataFrame:
    """Documents with their entity array and its fingerprint (empty when there are none).

    The array of a document is bounded by the distinct names in its own text.
    """
    grouped = find(docs, key, body, gazetteer, **options).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col("name").alias("text"), "label"))).alias("entities")
    )
    none = F.array().cast("array<struct<text:string,label:string>>")
    return (
        docs.join(grouped, key, "left")
        .withColumn("entities", F.coalesce("entities", none))
        .withColumn("fingerprint", text.fingerprint(F.col("entities")))
    )


def volatility(docs: DataFrame, title: str, body: str, editorial: DataFrame | None = None,
               per_pattern: int = 10_000) -> DataFrame:
    """Topics, volatility and tier; editorial keywords in the title count when there is a fingerprint.

    The editorial list is kept by hand. It is read into patterns of ``per_pattern`` keywords each.
    """
    marked = docs.withColumn("topics", text.topics(F.col(body)))
    volatile = text.is_volatile(F.col("topics"), F.col(body))
    if editorial is not None:
        words = sorted(r[0] for r in editorial.where("keyword IS NOT NULL").select(F.lower("keyword")).distinct().collect())
        for first in range(0, len(words), per_pattern):
            pattern = "|".join(re.escape(w) for w in words[first:first + per_pattern])
            volatile = volatile | ((F.col("fingerprint") != "") & F.lower(title).rlike(pattern))
    return marked.withColumn("volatile", volatile).withColumn("tier", text.tier(F.col("volatile")))


def evidence_grade(df: DataFrame, answer: str) -> DataFrame:
    """Grade columns parsed from a JSON answer; an unreadable one is low, 0.0 and for a human."""
    schema = (
        "confidence_level string, confidence_score double, reason string, evidence_type string, "
        "system_verifiable boolean, requires_human boolean"
    )
    parsed = df.withColumn("_g", text.parse_answer(F.col(answer), schema))
    levels = ("high", "medium", "low")
    valid = F.coalesce(
        F.col("_g.confidence_level").isin(*levels) & F.col("_g.confidence_score").isNotNull() & F.col("_g.reason").isNotNull(),
        F.lit(False),
    )
    return parsed.select(
        *df.columns,
        F.when(valid, F.col("_g.confidence_level")).otherwise("low").alias("confidence_level"),
        F.when(valid, F.col("_g.confidence_score")).otherwise(0.0).alias("confidence_score"),
        F.when(valid, F.coalesce("_g.requires_human", F.lit(False))).otherwise(True).alias("requires_human"),
        F.when(valid, F.coalesce("_g.system_verifiable", F.lit(False))).otherwise(False).alias("system_verifiable"),
        F.coalesce("_g.evidence_type", F.lit("unclassified")).alias("evidence_type"),
    )


def latest_version(docs: DataFrame, document_id: str, version: str) -> DataFrame:
    """Newest version per base id; reduced before the shuffle."""
    return latest_per(docs.withColumn("base_id", text.base_id(F.col(document_id))), ["base_id"], [F.col(version)])


def merge_tags(given: Column, found: Column) -> Column:
    """Sorted union of two tag arrays."""
    return F.array_sort(F.array_union(given, found))


def chunks(docs: DataFrame, document_id: str, body: str, separator: str = r"\n{2,}", cfg: Retrieval = RETRIEVAL,
           label_before_flush: bool = True) -> DataFrame:
    """(document_id, chunk_index, chunk_id, text, section): paragraphs packed up to the chunk size.

    The next chunk starts with the last words of the one before. By default a
    chunk that is closed by a heading carries that heading's label;
    ``label_before_flush=False`` gives it the label its own text was under.
    Each document is one row, folded natively.
    """
    def trimmed(value: Column) -> Column:
        return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")

    paragraphs = F.filter(F.transform(F.split(body, separator), trimmed), lambda p: p != "")
    state_type = "struct<done:array<struct<text:string,section:string>>,current:string,section:string>"
    start = F.from_json(F.lit('{"done": [], "current": "", "section": ""}'), state_type)

    def pack(state: Column, paragraph: Column) -> Column:
        heading = text.section(paragraph)
        label = F.when(heading != "", heading).otherwise(state["section"])
        full = (F.length(state["current"]) + F.length(paragraph) + 1 > cfg.chunk_size) & (state["current"] != "")
        closed = F.struct(
            trimmed(state["current"]).alias("text"), (label if label_before_flush else state["section"]).alias("section")
        )
        words = F.split(trimmed(state["current"]), r"(?U)\s+")
        kept = F.greatest(F.size(words) - cfg.chunk_overlap_words, F.lit(0))
        overlap = F.array_join(F.slice(words, kept + 1, F.lit(cfg.chunk_overlap_words)), " ")
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(closed))).otherwise(state["done"]).alias("done"),
            F.when(full, F.concat(overlap, F.lit("\n\n"), paragraph))
            .when(state["current"] == "", paragraph)
            .otherwise(trimmed(F.concat(state["current"], F.lit("\n\n"), paragraph))).alias("current"),
            label.alias("section"),
        )

    def finish(state: Column) -> Column:
        rest = F.struct(trimmed(state["current"]).alias("text"), state["section"].alias("section"))
        return F.when(trimmed(state["current"]) != "", F.concat(state["done"], F.array(rest))).otherwise(state["done"])

    packed = docs.select(document_id, F.posexplode(F.aggregate(paragraphs, start, pack, finish)).alias("chunk_index", "_c"))
    return packed.select(
        F.col(document_id).alias("document_id"), "chunk_index",
        text.chunk_id(F.col(document_id), F.col("chunk_index")).alias("chunk_id"), "_c.text", "_c.section",
    )
