"""Filtered and two-tier vector search, merging, reranking, relevance gate and grounding.

Many queries run in one plan: every operator takes a table of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.config import CLINICAL, RETRIEVAL, Clinical, Retrieval
from tracemill.functions.scores import confidence_tier
from tracemill.operators.skew import latest_per, stage, top_per
from tracemill.operators.vectors import CHUNK_ROWS, cosine, nearest, nearest_over

Spec = Mapping[str, Any]


def card_filter(jurisdiction: list[str] | None = None, doc_type: str | None = None, tags: list[str] | None = None,
                date_from=None, date_to=None) -> dict[str, Any]:
    """Filter spec from the given parts; empty parts are left out."""
    spec: dict[str, Any] = {k: v for k, v in (("jurisdiction", jurisdiction), ("doc_type", doc_type), ("tags", tags)) if v}
    span = {k: v for k, v in (("gte", date_from), ("lte", date_to)) if v}
    return spec | ({"date": span} if span else {})


def merge_filter(base: Spec | None, sub: Spec | None) -> dict[str, Any]:
    """Base spec overlaid by a sub-query's spec; one jurisdiction or tag becomes a list."""
    lists = ("jurisdiction", "tags")
    return dict(base or {}) | {k: [v] if k in lists and isinstance(v, str) else v for k, v in (sub or {}).items()}


def predicate(schema: T.StructType, spec: Spec) -> Column:
    """A spec as one condition: a list matches any, ``gte``/``lte`` is a range, else equality.

    On an array column the condition holds when any element fulfils it.
    """
    def one(name: str, wanted: Any) -> Column:
        column, kind = F.col(name), schema[name].dataType
        if isinstance(kind, T.ArrayType):
            if isinstance(wanted, (list, tuple, set)):
                return F.arrays_overlap(column, F.array(*[F.lit(w) for w in wanted]))
            if isinstance(wanted, Mapping):
                return F.exists(column, lambda e: span(e, wanted, kind.elementType))
            return F.array_contains(column, wanted)
        if isinstance(wanted, (list, tuple, set)):
            return column.isin(*wanted)
        return span(column, wanted, kind) if isinstance(wanted, Mapping) else column == F.lit(wanted)

    def span(value: Column, wanted: Mapping, kind: T.DataType) -> Column:
        parts = []
        if wanted.get("gte") is not None:
            parts.append(value >= F.lit(wanted["gte"]).cast(kind))
        if wanted.get("lte") is not None:
            parts.append(value <= F.lit(wanted["lte"]).cast(kind))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    return reduce(lambda a, b: a & b, [one(n, w) for n, w in spec.items()], F.lit(True))


def apply_filter(df: DataFrame, spec: Spec | None) -> DataFrame:
    return df.where(predicate(df.schema, spec)) if spec else df


def in_namespace(df: DataFrame, prefix: str, column: str = "document_id") -> DataFrame:
    """Rows under an id prefix; a prefix condition is pushed to the scan."""
    return df.where(F.col(column).startswith(prefix))


def search_cards(queries: DataFrame, cards: DataFrame, k: int = RETRIEVAL.card_top_k, spec: Spec | None = None,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Top ``k`` cards per query by cosine, after the metadata filter."""
    kept = apply_filter(cards, spec).select("document_id", "embedding")
    return nearest(queries.select("query_id", "embedding"), kept, k, base_id="document_id", vec="embedding", chunk_rows=chunk_rows)


def search_in_documents(queries: DataFrame, matched: DataFrame, chunks: DataFrame, k: int = RETRIEVAL.chunk_top_k,
                        chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Top ``k`` chunks per query among its matched documents (``matched``: query_id, document_id)."""
    matched = stage(matched.select("query_id", "document_id").distinct())
    asked = matched.join(queries.select("query_id", "embedding"), "query_id")
    stored = chunks.select("document_id", "chunk_id", "embedding").join(
        matched.select("document_id").distinct(), "document_id", "left_semi"
    )
    return nearest_over(asked, stored, k, on=("document_id",), base_id="chunk_id", vec="embedding", chunk_rows=chunk_rows)


def two_tier(queries: DataFrame, cards: DataFrame, chunks: DataFrame, spec: Spec | None = None,
             cfg: Retrieval = RETRIEVAL, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Cards first, then chunks only within the matched documents."""
    matched = search_cards(queries, cards, cfg.card_top_k, spec, chunk_rows)
    return search_in_documents(queries, matched, chunks, cfg.chunk_top_k, chunk_rows)


def merge_hits(hits: DataFrame) -> DataFrame:
    """Hits of all sub-queries, each chunk once per query: its first occurrence by sub-query and rank."""
    return latest_per(hits, ["query_id", "chunk_id"], [F.col("sub_query"), F.col("rank")], newest=False)


def rerank(pairs: DataFrame, k: int = RETRIEVAL.rerank_top_k, score: str = "rerank_score") -> DataFrame:
    """Best ``k`` pairs per query by a supplied score, ties by chunk id."""
    return top_per(pairs, ["query_id"], [F.col(score).desc(), F.col("chunk_id")], k, "rerank_rank")


def relevance_gate(hits: DataFrame, grades: DataFrame, keys: tuple[str, ...] = ("query_id", "chunk_id")) -> DataFrame:
    """Drop hits graded irrelevant; a missing grade counts as ambiguous and is kept."""
    graded = hits.join(grades.select(*keys, "grade"), list(keys), "left")
    return graded.withColumn("grade", F.coalesce("grade", F.lit("ambiguous"))).where(F.col("grade") != "irrelevant")


def ground(sentences: DataFrame, chunks: DataFrame, threshold: float = RETRIEVAL.faithfulness_threshold,
           chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Best chunk per sentence of the same answer; grounded from the threshold on.

    ``sentences``: (answer_id, sentence_id, embedding); ``chunks``:
    (answer_id, chunk_id, citation, embedding). A sentence of an answer
    without chunks makes no claim. Only a positive score names a chunk.
    """
    best = nearest(
        sentences, chunks, 1, on=("answer_id",), query_id="sentence_id", base_id="chunk_id", vec="embedding", chunk_rows=chunk_rows,
    ).drop("rank")
    cited = chunks.select("answer_id", "chunk_id", "citation")
    claims = sentences.drop("embedding").join(best, ["answer_id", "sentence_id"]).join(cited, ["answer_id", "chunk_id"])
    positive = F.col("score") > 0
    return (
        claims.withColumn("similarity", F.round(F.greatest("score", F.lit(0.0)), 4))
        .withColumn("grounded", F.greatest("score", F.lit(0.0)) >= threshold)
        .withColumn("chunk_id", F.when(positive, F.col("chunk_id")))
        .withColumn("citation", F.when(positive, F.col("citation")))
        .drop("score")
    )


def faithfulness(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """Share of grounded claims per answer, 1.0 for an answer without claims."""
    shares = claims.groupBy("answer_id").agg(
        F.avg(F.col("grounded").cast("double")).alias("_share"), F.count(F.lit(1)).alias("claims"),
        F.count_if(~F.col("grounded")).alias("ungrounded"),
    )
    return answers.select("answer_id").distinct().join(shares, "answer_id", "left").select(
        "answer_id", F.coalesce("_share", F.lit(1.0)).alias("faithfulness"),
        F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("ungrounded", F.lit(0)).alias("ungrounded"),
    )


def grounded_text(claims: DataFrame) -> DataFrame:
    """Answers rejoined from their grounded sentences in order (a group is the sentences of one answer text)."""
    kept = F.sort_array(F.collect_list(F.when(F.col("grounded"), F.struct("sentence_id", "sentence"))))
    return claims.groupBy("answer_id").agg(
        F.array_join(F.transform(kept, lambda s: s["sentence"]), " ").alias("grounded_answer")
    )


def context_block(hits: DataFrame, order: str = "rank", max_chunks: int = RETRIEVAL.rerank_top_k) -> DataFrame:
    """Numbered chunks with citation per query, at most ``max_chunks`` of them."""
    numbered = top_per(hits, ["query_id"], [F.col(order)], max_chunks, "_n")
    part = F.concat(
        F.lit("[Context "), F.col("_n").cast("string"), F.lit("] Citation: "), F.col("citation"), F.lit("\n"), F.col("text")
    )
    parts = F.sort_array(F.collect_list(F.struct("_n", part.alias("part"))))
    return numbered.groupBy("query_id").agg(
        F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n---\n\n").alias("context")
    )


def evidence_pool(evidence: DataFrame, max_items: int = 50, max_chars: int = 800) -> DataFrame:
    """Evidence pool text per query: tier and source of each item, content cut at ``max_chars``."""
    numbered = top_per(evidence, ["query_id"], [F.col("confidence").desc(), F.col("source_id")], max_items, "_n")
    part = F.concat(
        F.lit("\n[SOURCE_"), F.col("_n").cast("string"), F.lit("] ("), F.col("tier"), F.lit(" confidence, source: "),
        F.col("source_type"), F.lit("):\n"), F.substring("content", 1, max_chars),
    )
    parts = F.sort_array(F.collect_list(F.struct("_n", part.alias("part"))))
    body = F.array_join(F.transform(parts, lambda p: p["part"]), "\n")
    return numbered.groupBy("query_id").agg(F.concat(F.lit("EVIDENCE POOL:\n"), body).alias("pool"))


def search_findings(queries: DataFrame, findings: DataFrame, k: int = CLINICAL.evidence_top_k,
                    cfg: Clinical = CLINICAL, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Top ``k`` findings of the query's own patient with a confidence tier and the finding date."""
    hits = nearest(
        queries.select("patient_id", "query_id", "embedding"), findings.select("patient_id", "finding_id", "embedding"), k,
        on=("patient_id",), base_id="finding_id", vec="embedding", chunk_rows=chunk_rows,
    )
    details = findings.drop("embedding")
    return hits.join(details, ["patient_id", "finding_id"]).withColumn("tier", confidence_tier(F.col("score"), cfg))


def similar_cases(timelines: DataFrame, k: int = CLINICAL.similar_cases, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Closest timelines of other patients."""
    return nearest(
        timelines.select(F.col("patient_id").alias("query_id"), "embedding"),
        timelines.select(F.col("patient_id").alias("case_id"), "embedding"), k,
        base_id="case_id", vec="embedding", exclude_self=True, chunk_rows=chunk_rows,
    )


def similarity_filter(pairs: DataFrame, old_vec: str, new_vec: str, old_text: str, new_text: str,
                      threshold: float) -> DataFrame:
    """Cosine of old and new answer, 0 and kept when one is blank; skip from the threshold on."""
    blank = (F.trim(old_text) == "") | (F.trim(new_text) == "")
    score = F.when(blank, 0.0).otherwise(cosine(F.col(old_vec), F.col(new_vec)))
    return pairs.withColumn("similarity", score).withColumn("skip", ~blank & (F.col("similarity") >= threshold))


def answer_batch(queries: DataFrame, sub_queries: DataFrame, cards: DataFrame, chunks: DataFrame, grades: DataFrame,
                 answers: DataFrame, score: Callable[[DataFrame], DataFrame], spec: Spec | None = None,
                 cfg: Retrieval = RETRIEVAL, chunk_rows: int = CHUNK_ROWS,
                 grade_keys: tuple[str, ...] = ("query_id", "chunk_id")) -> DataFrame:
    """All queries from retrieval to grounding: per query counts and faithfulness.

    ``sub_queries``: (query_id, sub_query, embedding); ``grades``: (query_id,
    chunk_id, grade); ``answers``: (answer_id = query_id, sentence_id,
    embedding). ``score`` adds ``rerank_score`` to (query_id, chunk_id) pairs.
    """
    # A sub-query searches on its own; its id keeps the query and the number apart.
    asked = sub_queries.withColumn("_sub", F.struct("query_id", "sub_query")).select(
        F.to_json("_sub").alias("query_id"), F.col("query_id").alias("_query"), "sub_query", "embedding"
    )
    hits = two_tier(asked.select("query_id", "embedding"), cards, chunks, spec, cfg, chunk_rows)
    named = hits.join(asked.drop("embedding"), "query_id").select(
        F.col("_query").alias("query_id"), "sub_query", "rank", "chunk_id", "score"
    )
    merged = stage(merge_hits(named))
    top = rerank(score(merged), cfg.rerank_top_k)
    passed = stage(relevance_gate(top, grades, grade_keys))
    evidence = passed.select(F.col("query_id").alias("answer_id"), "chunk_id").join(
        chunks.select("chunk_id", "citation", "embedding"), "chunk_id"
    )
    claims = ground(answers, evidence, cfg.faithfulness_threshold, chunk_rows)
    shares = faithfulness(queries.select(F.col("query_id").alias("answer_id")), claims).withColumnRenamed("answer_id", "query_id")
    found = merged.groupBy("query_id").agg(F.count(F.lit(1)).alias("retrieved"))
    kept = passed.groupBy("query_id").agg(F.count(F.lit(1)).alias("passed"))
    return (
        shares.join(found, "query_id", "left").join(kept, "query_id", "left")
        .withColumn("retrieved", F.coalesce("retrieved", F.lit(0))).withColumn("passed", F.coalesce("passed", F.lit(0)))
    )
