"""Queries over articles (documents: title = first line, arrival by a spread of minutes) and their vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import articles, documents, gate, relational
from tracemill.operators.embedding import embed
from tracemill.operators.skew import stage
from tracemill.plans import ingest
from tracemill.registry import query
from tracemill.registry.tables import hashed_vectors_sql, table
from tracemill.registry.text import GAZETTEER_SQL, HTML_SQL, TOPICS_SQL, gazetteer, legal_documents, ID_SQL
from tracemill.sources import readers, sinks

AS_OF = "2024-01-31"

ARTICLES_SQL = f"""
{TOPICS_SQL}, {GAZETTEER_SQL}, arts AS (
  SELECT d.doc_id AS article_id, 'https://news.example/' || d.doc_id // 2 AS url, d.source, d.text AS body, t.topics,
         TIMESTAMP '2024-01-01' + to_minutes((d.doc_id * 7919) % 43200) AS published_at, p.fingerprint,
         CASE WHEN d.doc_id % 3 = 0 THEN 'hot' ELSE 'warm' END AS tier, d.doc_id % 11 = 5 AS stale,
         CASE WHEN d.doc_id % 13 = 4 THEN 'archived' ELSE 'accepted' END AS status
  FROM documents d JOIN topical t ON t.doc_id = d.doc_id JOIN prints p ON p.doc_id = d.doc_id)
"""
VECTORS_SQL = hashed_vectors_sql("vectors", "documents", "doc_id", "text")


def plain_articles(spark, sf_dir):
    """Documents as articles without vectors."""
    docs = documents.with_entities(table(spark, sf_dir, "documents"), "doc_id", "text", gazetteer(spark, sf_dir))
    number = F.col("doc_id")
    minutes = (number * 7919) % 43_200
    return docs.select(
        number.alias("article_id"), F.concat(F.lit("https://news.example/"), F.floor(number / 2)).alias("url"), "source",
        F.regexp_extract("text", r"^[^\n]*", 0).alias("title"), F.col("text").alias("body"),
        F.array_join(text.topics(F.col("text")), ",").alias("topics"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=minutes)).alias("published_at"),
        "fingerprint", F.when(number % 3 == 0, "hot").otherwise("warm").alias("tier"), (number % 11 == 5).alias("stale"),
        F.when(number % 13 == 4, "archived").otherwise("accepted").alias("status"),
    )


def vector_articles(spark, sf_dir):
    return embed(plain_articles(spark, sf_dir), F.col("body"))


def as_of():
    return F.lit(AS_OF).cast("timestamp")


@query("udf1_embed", f"""
WITH {VECTORS_SQL}
SELECT doc_id, i - 1 AS dim, round(e[i], 6) AS weight FROM (SELECT doc_id, e, unnest(range(1, 65)) AS i FROM vectors) WHERE e[i] <> 0
""")
def udf1(spark, sf_dir):
    vectors = embed(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"))
    return vectors.select("doc_id", F.posexplode("embedding").alias("dim", "weight")).where("weight <> 0").select(
        "doc_id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("weight").cast("double"), 6).alias("weight")
    )


@query("src1_decode_messages", f"""
WITH {ARTICLES_SQL}
SELECT url, source, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, length(body) AS chars, false AS rejected
FROM arts WHERE article_id % 10 > 1
UNION ALL SELECT '', '', '', 0, true FROM arts WHERE article_id % 10 <= 1
""")
def src1(spark, sf_dir):
    # One message in five is broken: cut short, or without a title.
    messages = plain_articles(spark, sf_dir).withColumn("raw_tags", F.split("topics", ","))
    body = F.to_json(F.struct("url", "source", "title", "body", F.col("published_at").cast("string").alias("published_at"), "raw_tags"))
    damaged = (
        F.when(F.col("article_id") % 10 == 0, F.substring(body, 1, 20))
        .when(F.col("article_id") % 10 == 1, F.lit('{"url": "u", "source": "s"}')).otherwise(body)
    )
    good, rejects = readers.decode_articles(messages.select(damaged.alias("value")))
    return good.select(
        "url", "source", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
        F.length("body").cast("bigint").alias("chars"), F.lit(False).alias("rejected"),
    ).unionByName(rejects.select(
        F.lit("").alias("url"), F.lit("").alias("source"), F.lit("").alias("published_at"),
        F.lit(0).cast("bigint").alias("chars"), F.lit(True).alias("rejected"),
    ))


@query("src2_encode_messages", """
SELECT 'https://news.example/' || page_id AS key, json_object('url', 'https://news.example/' || page_id, 'source', 's' || page_id % 5, 'title', 't',
  'body', 'b' || page_id, 'published_at', '2024-01-01T00:00:00', 'raw_tags', ['a', 'b'], 'scraped_at', '2024-01-31T00:00:00') AS value FROM pages
""")
def src2(spark, sf_dir):
    made = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("https://news.example/"), "page_id").alias("url"), F.concat(F.lit("s"), F.col("page_id") % 5).alias("source"),
        F.lit("t").alias("title"), F.concat(F.lit("b"), "page_id").alias("body"),
        F.lit("2024-01-01").cast("timestamp").alias("published_at"), F.array(F.lit("a"), F.lit("b")).alias("raw_tags"),
    )
    return readers.encode_articles(made, as_of())


FEED_SQL = f"""
bodies AS (SELECT page_id, url, {HTML_SQL} AS body FROM pages),
items AS (SELECT page_id, CASE WHEN page_id % 17 = 0 THEN '' ELSE 'https://f.example/' || page_id // 2 END AS link,
                 CASE WHEN page_id % 7 = 0 THEN '' ELSE body END AS body FROM bodies)
"""


def feed_items(spark, sf_dir):
    """Feed items from pages: some without link or text, two items per link, several date forms."""
    number = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        F.when(number % 17 == 0, "").otherwise(F.concat(F.lit("https://f.example/"), F.floor(number / 2))).alias("link"),
        F.concat(F.lit("item "), number).alias("title"), F.when(number % 7 == 0, "").otherwise(F.col("html")).alias("content"),
        F.when(number % 7 == 0, "").otherwise("unused").alias("description"),
        F.when(number % 3 == 0, "Tue, 02 Jan 2024 10:00:00 GMT").when(number % 3 == 1, "not a date").alias("pubDate"),
        F.when(number % 3 == 1, "2024-01-03T05:06:07").alias("updated"), F.array(F.lit("news")).alias("category"), number.alias("_order"),
    ).orderBy("_order").drop("_order")


@query("src3_feed_articles", f"""
WITH {FEED_SQL}, firsts AS (SELECT link, min_by(body, page_id) AS body, min(page_id) AS page_id FROM items WHERE link <> '' GROUP BY 1)
SELECT link AS url, 'item ' || page_id AS title, length(body) AS chars,
       CASE page_id % 3 WHEN 0 THEN '2024-01-02 10:00:00' WHEN 1 THEN '2024-01-03 05:06:07' ELSE '2024-01-31 00:00:00' END AS published_at
FROM firsts WHERE body <> ''
""")
def src3(spark, sf_dir):
    made = readers.feed_articles(feed_items(spark, sf_dir), F.lit("pages"), as_of())
    return made.select(
        "url", "title", F.length("body").cast("bigint").alias("chars"),
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
    )


@query("src5_published", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE '2024-01-31 00:00:00' END AS published_at FROM events
""")
def src5(spark, sf_dir):
    number, rfc = F.col("event_id") % 4, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(number == 0, F.concat(rfc, F.lit(" +0000"))).when(number == 1, "yesterday").when(number == 2, "").alias("published"),
        F.when(number == 1, F.concat(rfc, F.lit(" GMT"))).when(number == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("updated"),
    )
    when = readers.parse_published(F.col("published"), F.col("updated"), as_of())
    return rows.select("event_id", F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("snk1_insert_absent", f"""
WITH {ARTICLES_SQL}, old AS (SELECT url, min_by(article_id, struct_pack(published_at, article_id)) AS article_id FROM arts WHERE tier = 'hot' GROUP BY 1),
fresh AS (SELECT url, min_by(article_id, struct_pack(published_at, article_id)) AS article_id FROM arts WHERE tier = 'warm' GROUP BY 1)
SELECT * FROM old UNION ALL SELECT * FROM fresh WHERE url NOT IN (SELECT url FROM old)
""")
def snk1(spark, sf_dir):
    rows = plain_articles(spark, sf_dir).select("url", "article_id", "published_at", "tier")
    order = [F.col("published_at"), F.col("article_id")]
    old = relational.insert_absent(None, rows.where("tier = 'hot'"), ["url"], order)
    return relational.insert_absent(old, rows.where("tier = 'warm'"), ["url"], order).select("url", "article_id")


@query("snk3_replace_chunks", """
SELECT doc_id, count(*) AS chunks, CAST(sum(length(line)) AS BIGINT) AS chars, bool_or(fresh) AS fresh FROM (
  SELECT doc_id, unnest(string_split(CASE WHEN doc_id % 4 = 0 THEN text || chr(10) || 'v2' ELSE text END, chr(10))) AS line, doc_id % 4 = 0 AS fresh FROM documents)
GROUP BY 1
""")
def snk3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")

    def chunked(df, body, fresh):
        return df.select("doc_id", F.explode(F.split(body, "\n")).alias("line"), F.lit(fresh).alias("fresh"))

    new = chunked(docs.where("doc_id % 4 = 0"), F.concat("text", F.lit("\nv2")), True)
    replaced = relational.replace_by_key(chunked(docs, F.col("text"), False), new, "doc_id")
    return replaced.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("line")).alias("chars"), F.bool_or("fresh").alias("fresh")
    )


@query("snk9_index_points", """
SELECT CAST(('0x' || substr(md5('finding:' || label), 1, 16))::UHUGEINT % 9223372036854775808 AS BIGINT) AS point_id,
       max(vec_id) AS version, round(CAST(max_by(embedding[1], vec_id) AS DOUBLE), 6) AS first_weight FROM embeddings GROUP BY label
""")
def snk9(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    named = F.concat(F.lit("finding:"), "label")
    old = sinks.index_points(None, vectors.where("vec_id % 2 = 0"), named, F.col("vec_id"))
    points = sinks.index_points(old, vectors.where("vec_id % 2 = 1"), named, F.col("vec_id"))
    return points.select("point_id", "version", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_weight"))


@query("flt10_current", f"""
WITH {ARTICLES_SQL} SELECT article_id FROM arts WHERE NOT stale AND status <> 'archived'
""")
def flt10(spark, sf_dir):
    return articles.current(plain_articles(spark, sf_dir)).select("article_id")


@query("flt11_mark_stale", f"""
WITH {ARTICLES_SQL}, pairs AS (SELECT url, min(article_id) AS article_id, max(article_id) AS newer FROM arts GROUP BY 1 HAVING count(*) > 1)
SELECT a.article_id, stale OR p.newer IS NOT NULL AS stale, coalesce(p.newer, -1) AS superseded_by,
       CASE WHEN p.newer IS NOT NULL THEN 'stale' ELSE status END AS status FROM arts a LEFT JOIN pairs p USING (article_id)
""")
def flt11(spark, sf_dir):
    rows = plain_articles(spark, sf_dir)
    pairs = rows.groupBy("url").agg(F.min("article_id").alias("article_id"), F.max("article_id").alias("superseded_by")).where(
        "superseded_by > article_id"
    )
    marked = articles.mark_stale(rows, pairs, as_of())
    return marked.select("article_id", "stale", F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"), "status")


@query("flt12_archive_cold", f"""
WITH {ARTICLES_SQL}
SELECT article_id, CASE WHEN tier = 'warm' AND published_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND NOT stale THEN 'cold' ELSE tier END AS tier FROM arts
""")
def flt12(spark, sf_dir):
    return articles.archive_cold(plain_articles(spark, sf_dir), as_of()).select("article_id", "tier")


@query("agg9_tier_sizes", f"""
WITH {ARTICLES_SQL}, moved AS (
  SELECT CASE WHEN tier = 'warm' AND published_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND NOT stale THEN 'cold' ELSE tier END AS tier FROM arts)
SELECT tier, count(*) AS articles FROM moved GROUP BY 1
""")
def agg9(spark, sf_dir):
    return articles.tier_sizes(articles.archive_cold(plain_articles(spark, sf_dir), as_of()))


STORIES_SQL = f"""
{ARTICLES_SQL}, clustered AS (SELECT * FROM arts WHERE fingerprint <> ''),
known AS (SELECT fingerprint, 'known-' || fingerprint AS story_id FROM clustered GROUP BY 1 HAVING min(article_id) % 2 = 0),
assigned AS (
  SELECT c.*, coalesce(k.story_id, 'story-' || substr(sha256(c.fingerprint), 1, 16)) AS story_id FROM clustered c LEFT JOIN known k USING (fingerprint))
"""


def stories(spark, sf_dir):
    clustered = plain_articles(spark, sf_dir).where("fingerprint <> ''")
    known = clustered.groupBy("fingerprint").agg(F.min("article_id").alias("low")).where("low % 2 = 0").select(
        F.concat(F.lit("known-"), "fingerprint").alias("story_id"), "fingerprint", F.lit("old").alias("topic"),
        F.lit(-1).cast("bigint").alias("latest_article_id"), F.lit("2023-01-01").cast("timestamp").alias("updated_at"),
    )
    return articles.assign_story(clustered, known)


@query("joi17_assign_story", f"WITH {STORIES_SQL} SELECT article_id, story_id FROM assigned")
def joi17(spark, sf_dir):
    return stories(spark, sf_dir)[0].select("article_id", "story_id")


@query("joi17_stories", f"""
WITH {STORIES_SQL}
SELECT story_id, CASE WHEN starts_with(story_id, 'known') THEN 'old' ELSE min_by(topics, struct_pack(published_at, article_id)) END AS topic,
       max_by(article_id, struct_pack(published_at, article_id)) AS latest_article_id FROM assigned GROUP BY story_id
""")
def joi17_stories(spark, sf_dir):
    return stories(spark, sf_dir)[1].select("story_id", "topic", "latest_article_id")


@query("agg8_story_stats", f"""
WITH {STORIES_SQL}
SELECT story_id, count(*) AS articles, max_by(article_id, struct_pack(published_at, article_id)) AS latest_article_id FROM assigned GROUP BY story_id
""")
def agg8(spark, sf_dir):
    return articles.story_stats(stories(spark, sf_dir)[0])


@query("win13_latest_version", f"""
WITH d AS (SELECT doc_id, doc_id % 3 + 1 AS version, regexp_replace({ID_SQL}, ':v[0-9]+$', '') AS base_id FROM documents)
SELECT base_id, max(version) AS version, max_by(doc_id, version) AS doc_id FROM d GROUP BY 1
""")
def win13(spark, sf_dir):
    docs = legal_documents(spark, sf_dir).select("doc_id", "document_id", (F.col("doc_id") % 3 + 1).alias("version"))
    return documents.latest_version(docs, "document_id", "version").select("base_id", "version", "doc_id")


@query("set5_merge_tags", f"""
WITH {TOPICS_SQL}
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(string_split(topics, ','), ['general', lang]))), ',') AS tags
FROM topical JOIN documents USING (doc_id)
""")
def set5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tags = documents.merge_tags(text.topics(F.col("text")), F.array(F.lit("general"), F.col("lang")))
    return docs.select("doc_id", F.array_join(tags, ",").alias("tags"))


SIMILAR_SQL = f"""
{ARTICLES_SQL}, {VECTORS_SQL}, scored AS (
  SELECT a.article_id AS query_id, b.article_id AS base_id, b.tier, a.fingerprint AS qf, b.fingerprint AS bf,
         a.published_at AS qt, b.published_at AS bt, a.stale AS qs, b.stale AS bs, round(list_dot_product(va.e, vb.e) / (sqrt(list_dot_product(va.e, va.e)) * sqrt(list_dot_product(vb.e, vb.e))), 6) AS score
  FROM arts a JOIN vectors va ON va.doc_id = a.article_id JOIN arts b ON a.article_id <> b.article_id JOIN vectors vb ON vb.doc_id = b.article_id
  WHERE list_dot_product(va.e, va.e) > 0 AND list_dot_product(vb.e, vb.e) > 0)
"""


@query("joi1_similar", f"""
WITH {SIMILAR_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY score DESC, base_id) AS rank FROM scored WHERE score >= 0.85)
SELECT query_id, tier, base_id, score, rank FROM ranked WHERE rank <= 5
""")
def joi1(spark, sf_dir):
    rows = stage(vector_articles(spark, sf_dir).select("article_id", "tier", "embedding"))
    return articles.similar(rows, rows).select("query_id", "tier", "base_id", "score", "rank")


@query("joi2_similar_by_entities", f"""
WITH {SIMILAR_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id) AS rank FROM scored WHERE score >= 0.3 AND qf = bf)
SELECT query_id, base_id, score, rank FROM ranked WHERE rank <= 20
""")
def joi2(spark, sf_dir):
    rows = stage(vector_articles(spark, sf_dir).select("article_id", "fingerprint", "embedding"))
    asked = rows.select(F.col("article_id").alias("query_id"), F.array("fingerprint").alias("fingerprints"), "embedding")
    return articles.similar_by_entities(asked, rows, min_score=0.3).select("query_id", "base_id", "score", "rank")


@query("joi6_supersede", f"""
WITH {SIMILAR_SQL}, fits AS (
  SELECT base_id AS article_id, query_id AS superseded_by, score, qt FROM scored
  WHERE qf = bf AND qf <> '' AND score >= 0.85 AND NOT bs AND NOT qs AND epoch(qt) - epoch(bt) >= 300)
SELECT article_id, min_by(superseded_by, struct_pack(qt, superseded_by)) AS superseded_by, min_by(score, struct_pack(qt, superseded_by)) AS score FROM fits GROUP BY 1
""")
def joi6(spark, sf_dir):
    return articles.supersede(vector_articles(spark, sf_dir))


TIER_SEARCH_SQL = f"""
{ARTICLES_SQL}, v AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE vec_id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' ELSE 'cold' END AS tier, vec_id % 11 = 5 AS stale FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, b.vec_id AS base_id, b.tier, CASE b.tier WHEN 'hot' THEN 0 WHEN 'warm' THEN 1 ELSE 2 END AS place, round(list_cosine_similarity(q.e, b.e), 6) AS score
  FROM v q, v b WHERE NOT b.stale AND round(list_cosine_similarity(q.e, b.e), 6) >= 0.3)
"""


def tiered_vectors(spark, sf_dir):
    number = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        number.alias("article_id"), "embedding", F.when(number % 3 == 0, "hot").when(number % 3 == 1, "warm").otherwise("cold").alias("tier"),
        (number % 11 == 5).alias("stale"), F.concat(F.lit("title "), number).alias("title"),
    )


@query("top4_search_tiers", f"""
WITH {TIER_SEARCH_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, score DESC, base_id) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY score DESC, base_id) AS r FROM scored) WHERE r <= 3)
SELECT query_id, base_id, tier, score, rank FROM ranked WHERE rank <= 3
""")
def top4(spark, sf_dir):
    rows = tiered_vectors(spark, sf_dir)
    hits = articles.search_tiers(rows.withColumnRenamed("article_id", "query_id"), rows, 3, 0.3)
    return hits.select("query_id", "base_id", "tier", "score", "rank")


@query("top4_whole_tiers", f"""
WITH {TIER_SEARCH_SQL}, top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY score DESC, base_id) AS r FROM scored) WHERE r <= 3)
SELECT t.query_id, t.base_id, t.tier, t.score FROM top t WHERE (SELECT count(*) FROM top o WHERE o.query_id = t.query_id AND o.place < t.place) < 3
""")
def top4_whole(spark, sf_dir):
    rows = tiered_vectors(spark, sf_dir)
    hits = articles.search_tiers(rows.withColumnRenamed("article_id", "query_id"), rows, 3, 0.3, whole_tier=True)
    return hits.select("query_id", "base_id", "tier", "score")


@query("joi18_hydrate", f"""
WITH {TIER_SEARCH_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, score DESC, base_id) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY score DESC, base_id) AS r FROM scored) WHERE r <= 3)
SELECT query_id, rank, base_id, 'title ' || base_id AS title FROM ranked WHERE rank <= 3
""")
def joi18(spark, sf_dir):
    rows = tiered_vectors(spark, sf_dir)
    hits = articles.search_tiers(rows.withColumnRenamed("article_id", "query_id"), rows, 3, 0.3)
    return articles.hydrate(hits, rows).select("query_id", "rank", "base_id", "title")


GATE_SQL = f"""
{SIMILAR_SQL}, near AS MATERIALIZED (SELECT query_id, base_id, score FROM scored WHERE score >= 0.85),
line AS MATERIALIZED (SELECT article_id, fingerprint, CAST(epoch(published_at) AS BIGINT) AS t, row_number() OVER (ORDER BY published_at, article_id) AS n FROM arts),
gate(n, stored, status) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, fp VARCHAR, t BIGINT)[]), ''
  UNION ALL
  SELECT j.n, CASE WHEN j.status = 'duplicate' THEN j.stored ELSE list_append(j.stored, {{'id': j.article_id, 'fp': j.fingerprint, 't': j.t}}) END, j.status
  FROM (
    SELECT l.n, l.article_id, l.fingerprint, l.t, g.stored,
           CASE WHEN l.fingerprint <> '' AND len(list_filter(g.stored, lambda s: s.fp = l.fingerprint AND l.t - s.t < 604800)) = 0 THEN 'accepted'
                WHEN b.best >= 0.97 THEN 'duplicate' WHEN b.best >= 0.85 THEN 'clustered' ELSE 'accepted' END AS status
    FROM gate g JOIN line l ON l.n = g.n + 1
    LEFT JOIN LATERAL (SELECT max(score) AS best FROM near p WHERE p.query_id = l.article_id AND list_contains(list_transform(g.stored, lambda s: s.id), p.base_id)) b ON true) j),
outcomes AS (SELECT l.article_id, g.status FROM gate g JOIN line l ON l.n = g.n)
"""


@query("dec1_dedup_gate", f"WITH RECURSIVE {GATE_SQL} SELECT article_id, status FROM outcomes")
def dec1(spark, sf_dir):
    return gate.dedup_gate(vector_articles(spark, sf_dir)).select("article_id", "status")


@query("agg15_gate_outcomes", f"WITH RECURSIVE {GATE_SQL} SELECT status AS label, count(*) AS total FROM outcomes GROUP BY 1")
def agg15_gate(spark, sf_dir):
    return gate.dedup_gate(vector_articles(spark, sf_dir)).groupBy(F.col("status").alias("label")).agg(F.count(F.lit(1)).alias("total"))


@query("dec2_ingest_articles")
def dec2(spark, sf_dir):
    raw = plain_articles(spark, sf_dir).select("article_id", "url", "source", "title", "body", "published_at")
    done = ingest.ingest_articles(raw, gazetteer(spark, sf_dir), as_of())
    return done["articles"].select("article_id", "url", "tier", "status", "stale", F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"))


CHUNKS_SQL = r"""
paras AS (
  SELECT doc_id, para, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (
    SELECT doc_id, i, regexp_replace(p, '^\s+|\s+$', '', 'g') AS para FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE para <> ''),
labelled AS (
  SELECT *, coalesce(last_value(CASE WHEN regexp_matches(para, '^(#+\s+.+|[A-Z][A-Z\s]+:)') THEN regexp_replace(regexp_extract(para, '^(#+\s+.+|[A-Z][A-Z\s]+:)', 1), '^\s+|\s+$', '', 'g') END IGNORE NULLS)
            OVER (PARTITION BY doc_id ORDER BY n), '') AS section FROM paras),
fold(doc_id, n, cur, emitted, section) AS (
  SELECT doc_id, n, para, CAST(NULL AS VARCHAR), section FROM labelled WHERE n = 1
  UNION ALL
  SELECT l.doc_id, l.n,
         CASE WHEN length(f.cur) + length(l.para) + 1 > 1500 THEN array_to_string(regexp_split_to_array(f.cur, '\s+')[-30:], ' ') || chr(10) || chr(10) || l.para ELSE f.cur || chr(10) || chr(10) || l.para END,
         CASE WHEN length(f.cur) + length(l.para) + 1 > 1500 THEN f.cur END, l.section
  FROM fold f JOIN labelled l ON l.doc_id = f.doc_id AND l.n = f.n + 1),
pieces AS (
  SELECT doc_id, n, emitted AS text, section FROM fold WHERE emitted IS NOT NULL
  UNION ALL SELECT f.doc_id, f.n + 1, f.cur, f.section FROM fold f JOIN (SELECT doc_id, max(n) AS n FROM fold GROUP BY 1) m ON m.doc_id = f.doc_id AND m.n = f.n),
chunked AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_index, text, section FROM pieces)
"""


@query("txt3_chunks", f"WITH RECURSIVE {CHUNKS_SQL} SELECT doc_id, chunk_index, text, section FROM chunked")
def txt3(spark, sf_dir):
    made = documents.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", r"\n")
    return made.select(F.col("document_id").alias("doc_id"), F.col("chunk_index").cast("bigint").alias("chunk_index"), "text", "section")


def raw_legal(spark, sf_dir):
    """Legal documents with the parts of their ids; one in 25 lacks its serial number."""
    number = F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in (*text.DOC_TYPE_CODES, "letter")])
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("country_code"), F.col("source").alias("state_code"), F.lit("d").alias("district_code"), (2000 + number % 20).alias("year"),
        F.element_at(kinds, (F.floor(number / 3) % 6 + 1).cast("int")).alias("doc_type"), F.when(number % 25 != 7, F.floor(number / 3).cast("string")).alias("serial"),
        "text", (number % 3 + 1).alias("version"),
    )


LEGAL_SQL = r"""
named AS (
  SELECT *, upper(lang) || ':' || upper(source) || ':D:' || (2000 + doc_id % 20) || ':' || CASE (doc_id // 3) % 6 WHEN 0 THEN 'CR' WHEN 1 THEN 'ST' WHEN 2 THEN 'RG' WHEN 3 THEN 'CN' WHEN 4 THEN 'AV' ELSE 'XX' END || ':' || doc_id // 3 AS base_id, doc_id % 3 + 1 AS version
  FROM documents WHERE doc_id % 25 <> 7),
newest AS (SELECT base_id, max(version) AS version, max_by(doc_id, version) AS doc_id FROM named GROUP BY 1)
"""


@query("dec12_ingest_documents", f"WITH {LEGAL_SQL} SELECT base_id, base_id || ':v' || version AS document_id, version FROM newest")
def dec12(spark, sf_dir):
    done = ingest.ingest_documents(raw_legal(spark, sf_dir), as_of(), separator=r"\n")
    return done["registry"].select("base_id", "document_id", "version")


@query("dec12_ingest_errors", "SELECT doc_id, 'missing required field' AS error FROM documents WHERE doc_id % 25 = 7")
def dec12_errors(spark, sf_dir):
    return ingest.ingest_documents(raw_legal(spark, sf_dir), as_of(), separator=r"\n")["errors"].select("doc_id", "error")


@query("dec12_ingest_chunks")
def dec12_chunks(spark, sf_dir):
    old = ingest.ingest_documents(raw_legal(spark, sf_dir).where("version < 3"), as_of(), separator=r"\n")
    new = ingest.ingest_documents(raw_legal(spark, sf_dir).where("version = 3"), as_of(), old["chunks"], old["registry"], r"\n")
    return new["chunks"].groupBy("base_id", "document_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))
