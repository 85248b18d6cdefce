"""Article steps: tiers, staleness, stories, similarity gates and search.

Articles have (article_id, url, source, title, body, published_at,
fingerprint, tier, status, stale, story_id, embedding).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.config import ARTICLES, Articles
from tracemill.operators.skew import latest_per, stage, top_per
from tracemill.operators.vectors import CHUNK_ROWS, SCORE_DECIMALS, STRIP, grid_join, nearest, nearest_over, unit_rows

TIERS = ("hot", "warm", "cold")


def current(articles: DataFrame) -> DataFrame:
    """Neither stale nor archived."""
    return articles.where(~F.col("stale") & (F.col("status") != "archived"))


def mark_stale(articles: DataFrame, pairs: DataFrame, as_of: Column) -> DataFrame:
    """Set staleness, its time, the newer article and the status; ``pairs`` has (article_id, superseded_by)."""
    marks = pairs.select("article_id", F.col("superseded_by").alias("_by"))
    hit = F.col("_by").isNotNull()
    return (
        articles.join(marks, "article_id", "left")
        .withColumn("stale", F.col("stale") | hit)
        .withColumn("stale_at", F.when(hit, as_of))
        .withColumn("superseded_by", F.col("_by"))
        .withColumn("status", F.when(hit, "stale").otherwise(F.col("status")))
        .drop("_by")
    )


def archive_cold(articles: DataFrame, as_of: Column, days: int = ARTICLES.archive_after_days) -> DataFrame:
    """Warm articles that are old and not stale become cold."""
    old = F.col("published_at") < as_of - F.make_interval(days=F.lit(days))
    move = (F.col("tier") == "warm") & old & ~F.col("stale")
    return articles.withColumn("tier", F.when(move, "cold").otherwise(F.col("tier")))


def tier_sizes(articles: DataFrame) -> DataFrame:
    return articles.groupBy("tier").agg(F.count(F.lit(1)).alias("articles"))


def story_stats(articles: DataFrame) -> DataFrame:
    """Size and latest article per story."""
    return articles.where(F.col("story_id").isNotNull()).groupBy("story_id").agg(
        F.count(F.lit(1)).alias("articles"),
        F.max_by("article_id", F.struct("published_at", "article_id")).alias("latest_article_id"),
    )


def assign_story(clustered: DataFrame, stories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, stories): each clustered article gets the story of its fingerprint, made when absent.

    ``clustered`` has (article_id, fingerprint, topics, published_at). A new
    story's id follows from the fingerprint, so a rerun makes the same story.
    """
    known = stories.select("fingerprint", F.col("story_id").alias("_known"))
    made = F.concat(F.lit("story-"), F.substring(F.sha2("fingerprint", 256), 1, 16))
    assigned = (
        clustered.join(known, "fingerprint", "left")
        .withColumn("story_id", F.coalesce("_known", made)).drop("_known").withColumn("status", F.lit("clustered"))
    )
    order = F.struct("published_at", "article_id")
    fresh = assigned.groupBy("story_id", "fingerprint").agg(
        F.min_by("topics", order).alias("topic"), F.max_by("article_id", order).alias("latest_article_id"),
        F.max("published_at").alias("updated_at"),
    )
    both = stories.select("story_id", "fingerprint", "topic", "latest_article_id", "updated_at", F.lit(0).alias("_new")).unionByName(
        fresh.withColumn("_new", F.lit(1))
    )
    merged = both.groupBy("story_id", "fingerprint").agg(
        F.min_by("topic", "_new").alias("topic"),
        F.max_by("latest_article_id", F.struct("updated_at", "_new")).alias("latest_article_id"),
        F.max("updated_at").alias("updated_at"),
    )
    return assigned, merged


def similar(queries: DataFrame, articles: DataFrame, k: int = ARTICLES.gate_matches,
            min_score: float = ARTICLES.cluster_threshold, tiers: Sequence[str] = ("hot", "warm"),
            chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Top ``k`` other articles per query and tier with at least ``min_score``."""
    asked = queries.select(F.col("article_id").alias("query_id"), "embedding").withColumn(
        "tier", F.explode(F.array(*[F.lit(t) for t in tiers]))
    )
    stored = articles.where(F.col("tier").isin(*tiers)).select(F.col("article_id").alias("base_id"), "tier", "embedding")
    return nearest(asked, stored, k, min_score, ("tier",), vec="embedding", exclude_self=True, chunk_rows=chunk_rows)


def similar_by_entities(queries: DataFrame, articles: DataFrame, k: int = ARTICLES.entity_matches,
                        min_score: float = ARTICLES.cluster_threshold, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Top ``k`` among the articles that share one of the query's fingerprints.

    ``queries`` has (query_id, fingerprints array, embedding).
    """
    asked = queries.select("query_id", "embedding", F.explode(F.array_distinct("fingerprints")).alias("fingerprint"))
    stored = articles.select(F.col("article_id").alias("base_id"), "fingerprint", "embedding")
    return nearest_over(asked, stored, k, min_score, ("fingerprint",), vec="embedding", exclude_self=True, chunk_rows=chunk_rows)


def supersede(articles: DataFrame, cfg: Articles = ARTICLES, chunk_rows: int = CHUNK_ROWS,
              newer: DataFrame | None = None) -> DataFrame:
    """(article_id, superseded_by, score): the first newer article that replaces each older one.

    ``newer`` limits which articles may replace (a batch that just arrived). Same non-empty fingerprint, close enough, and at least the minimum gap
    later. Only articles meet that the times of their fingerprint leave something to replace, or to be replaced by.
    Chunks of one fingerprint meet as matrices and each returns at most one candidate per older article.
    """
    def candidates(df: DataFrame) -> DataFrame:
        return stage(df.where((F.col("fingerprint") != "") & ~F.col("stale")).select(
            "article_id", "fingerprint", F.unix_timestamp("published_at").alias("at"), "embedding"
        ))

    live = candidates(articles)
    replacing = live if newer is None else candidates(newer)
    id_type = articles.schema["article_id"].dataType.simpleString()
    gap, floor = cfg.supersession_gap_seconds, cfg.cluster_threshold
    spans = stage(
        live.groupBy("fingerprint").agg(F.min("at").alias("_first"))
        .join(replacing.groupBy("fingerprint").agg(F.max("at").alias("_last")), "fingerprint").where(F.col("_last") - F.col("_first") >= gap)
    )
    older = stage(live.join(spans, "fingerprint").where(F.col("_last") - F.col("at") >= gap).select(*live.columns))
    later = stage(replacing.join(spans, "fingerprint").where(F.col("at") - F.col("_first") >= gap).select(*replacing.columns))

    def kernel(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        new = new.sort_values(["at", "article_id"], kind="stable")
        before, after, since = unit_rows(old["embedding"]), unit_rows(new["embedding"]), new["at"].to_numpy()
        parts = []
        for begin in range(0, len(old), STRIP):
            some = slice(begin, begin + STRIP)
            scores = np.round(before[some] @ after.T, SCORE_DECIMALS)
            fits = (since[None, :] - old["at"].to_numpy()[some, None] >= gap) & (scores >= floor)
            rows = np.nonzero(fits.any(axis=1))[0]
            first = fits[rows].argmax(axis=1)
            parts.append((rows + begin, first, scores[rows, first]))
        rows, first, scores = map(np.concatenate, zip(*parts, strict=True))
        return pd.DataFrame({
            "article_id": old["article_id"].to_numpy()[rows], "superseded_by": new["article_id"].to_numpy()[first],
            "at": since[first], "score": scores,
        })

    found = grid_join(
        older, later, ["fingerprint"], kernel, f"article_id {id_type}, superseded_by {id_type}, at long, score double",
        F.xxhash64("article_id"), F.xxhash64("article_id"), chunk_rows,
    )
    return latest_per(found, ["article_id"], [F.col("at"), F.col("superseded_by")], newest=False).drop("at")


def search_tiers(queries: DataFrame, articles: DataFrame, limit: int, min_score: float = ARTICLES.search_min_score,
                 whole_tier: bool = False, include_stale: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Hits per query in hot, then warm, then cold until the limit is reached.

    ``whole_tier`` keeps the whole tier in which the limit is reached.
    """
    searched = articles if include_stale else articles.where(~F.col("stale"))
    asked = queries.select("query_id", "embedding").withColumn("tier", F.explode(F.array(*[F.lit(t) for t in TIERS])))
    stored = searched.select(F.col("article_id").alias("base_id"), "tier", "embedding")
    hits = nearest(asked, stored, limit, min_score, ("tier",), vec="embedding", chunk_rows=chunk_rows)
    place = F.create_map(*[F.lit(v) for i, t in enumerate(TIERS) for v in (t, i)])[F.col("tier")]
    ordered = hits.drop("rank").withColumn("_place", place)
    if not whole_tier:
        return top_per(ordered, ["query_id"], [F.col("_place"), F.col("score").desc(), F.col("base_id")], limit).drop("_place")
    counts = ordered.groupBy("query_id").agg(*[
        F.count_if(F.col("_place") < i).alias(f"_before_{i}") for i in range(len(TIERS))
    ])
    before = F.element_at(F.array(*[F.col(f"_before_{i}") for i in range(len(TIERS))]), F.col("_place") + 1)
    kept = ordered.join(counts, "query_id").where(before < limit)
    return kept.select("query_id", "tier", "base_id", "score")


def hydrate(hits: DataFrame, articles: DataFrame, include_stale: bool = False) -> DataFrame:
    """Article columns for hits, the rank kept."""
    rows = articles if include_stale else articles.where(~F.col("stale"))
    return hits.join(rows.withColumnRenamed("article_id", "base_id").drop("embedding", "tier"), "base_id")
