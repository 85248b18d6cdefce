"""Queries over vectors (embeddings: chunk = row, document = id modulo 25, every row also asks)."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from tracemill.config import RETRIEVAL
from tracemill.operators import retrieval, vector_index
from tracemill.operators.embedding import score_pairs, shared_words
from tracemill.operators.skew import shared_folder
from tracemill.operators.vectors import cosine, nearest
from tracemill.registry import query
from tracemill.registry.tables import cosine_sql, table
from tracemill.registry.text import legal_documents

DOCUMENTS = 25

CHUNKS_SQL = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, 'D' || vec_id % 25 AS document_id, label FROM embeddings),
cards AS (
  SELECT 'D' || vec_id AS document_id, e, vec_id AS card_no FROM v WHERE vec_id < 25)
"""


def chunks(spark, sf_dir):
    number = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        number.alias("chunk_id"), F.concat(F.lit("D"), number % DOCUMENTS).alias("document_id"), "embedding", "label",
        F.concat(F.lit("D"), number % DOCUMENTS, F.lit(" | p."), number).alias("citation"),
    )


def cards(spark, sf_dir):
    """One card per document: the vector of its first chunk, with metadata."""
    number = F.col("chunk_id")
    firsts = chunks(spark, sf_dir).groupBy("document_id").agg(F.min_by(F.struct("chunk_id", "embedding"), "chunk_id").alias("f"))
    return firsts.select("document_id", "f.*").select(
        "document_id", "embedding", F.element_at(F.array(*[F.lit(k) for k in ("case_law", "statute", "contract")]), (number % 3 + 1).cast("int")).alias("doc_type"),
        F.array(F.lit("IN"), F.when(number % 2 == 0, "MH").otherwise("KA")).alias("jurisdiction"),
        F.array(F.concat(F.lit("t"), number % 4)).alias("tags"), F.date_add(F.lit("2020-01-01").cast("date"), (number * 30).cast("int")).alias("date"),
    )


def asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


@query("num1_cosine", f"""
WITH {CHUNKS_SQL} SELECT a.vec_id, round({cosine_sql('a.e', 'b.e')}, 6) AS score FROM v a JOIN v b ON b.vec_id = a.vec_id + 1
""")
def num1(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(following, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


SPEC = retrieval.card_filter(jurisdiction=["MH", "XX"], tags=["t0", "t2"], date_from="2020-02-15", date_to="2021-12-31")
SPEC_SQL = "card_no % 2 = 0 AND card_no % 4 IN (0, 2) AND DATE '2020-01-01' + CAST(card_no * 30 AS INTEGER) BETWEEN DATE '2020-02-15' AND DATE '2021-12-31'"


@query("top1_search_cards", f"""
WITH {CHUNKS_SQL}, ranked AS (
  SELECT q.vec_id AS query_id, c.document_id, round({cosine_sql('q.e', 'c.e')}, 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cosine_sql('q.e', 'c.e')}, 6) DESC, c.document_id) AS rank
  FROM v q, cards c WHERE {SPEC_SQL})
SELECT query_id, document_id, score, rank FROM ranked WHERE rank <= 5
""")
def top1(spark, sf_dir):
    return retrieval.search_cards(asked(spark, sf_dir), cards(spark, sf_dir), 5, SPEC).select("query_id", "document_id", "score", "rank")


@query("top1_indexed_cards", f"""
WITH {CHUNKS_SQL}, ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round({cosine_sql('q.e', 'c.e')}, 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cosine_sql('q.e', 'c.e')}, 6) DESC, c.vec_id) AS rank FROM v q, v c)
SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= 5
""")
def top1_indexed(spark, sf_dir):
    """Through a stored index with small cells, so that the cells are pruned on any table."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    vector_index.build(chunks(spark, sf_dir).select("chunk_id", "embedding"), path, "chunk_id", "embedding", cell_rows=64)
    return vector_index.search(spark, path, asked(spark, sf_dir), 5, "chunk_id", "embedding").select("query_id", "chunk_id", "score", "rank")


TWO_TIER_SQL = f"""
{CHUNKS_SQL}, matched AS (SELECT query_id, document_id FROM (
  SELECT q.vec_id AS query_id, c.document_id,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cosine_sql('q.e', 'c.e')}, 6) DESC, c.document_id) AS r FROM v q, cards c) WHERE r <= 20),
hits AS (SELECT query_id, chunk_id, document_id, score, rank FROM (
  SELECT m.query_id, c.vec_id AS chunk_id, c.document_id, round({cosine_sql('q.e', 'c.e')}, 6) AS score,
         row_number() OVER (PARTITION BY m.query_id ORDER BY round({cosine_sql('q.e', 'c.e')}, 6) DESC, c.vec_id) AS rank
  FROM matched m JOIN v q ON q.vec_id = m.query_id JOIN v c ON c.document_id = m.document_id) WHERE rank <= 50)
"""


@query("top2_two_tier", f"WITH {TWO_TIER_SQL} SELECT query_id, chunk_id, score, rank FROM hits")
def top2(spark, sf_dir):
    return retrieval.two_tier(asked(spark, sf_dir), cards(spark, sf_dir), chunks(spark, sf_dir)).select(
        "query_id", "chunk_id", "score", "rank"
    )


@query("joi3_search_in_documents", f"""
WITH {CHUNKS_SQL}, ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round({cosine_sql('q.e', 'c.e')}, 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cosine_sql('q.e', 'c.e')}, 6) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON c.document_id IN ('D' || q.label, 'D' || (q.label + 10)))
SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= 10
""")
def joi3(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    matched = rows.select(F.col("chunk_id").alias("query_id"), F.explode(F.array(
        F.concat(F.lit("D"), "label"), F.concat(F.lit("D"), F.col("label") + 10))).alias("document_id"))
    hits = retrieval.search_in_documents(asked(spark, sf_dir), matched, rows, 10)
    return hits.select("query_id", "chunk_id", "score", "rank")


@query("joi4_search_findings", f"""
WITH {CHUNKS_SQL}, ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id AS finding_id, round({cosine_sql('q.e', 'c.e')}, 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cosine_sql('q.e', 'c.e')}, 6) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON c.label = q.label)
SELECT query_id, finding_id, score, rank, CASE WHEN score >= 0.9 THEN 'HIGH' WHEN score >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM ranked WHERE rank <= 10
""")
def joi4(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "patient_id")
    found = retrieval.search_findings(rows.withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "finding_id"))
    return found.select("query_id", "finding_id", "score", "rank", "tier")


@query("joi5_similar_cases", f"""
WITH {CHUNKS_SQL}, ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id AS case_id, round({cosine_sql('q.e', 'c.e')}, 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cosine_sql('q.e', 'c.e')}, 6) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON c.vec_id <> q.vec_id)
SELECT query_id, case_id, score, rank FROM ranked WHERE rank <= 5
""")
def joi5(spark, sf_dir):
    return retrieval.similar_cases(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "patient_id"))


@query("set1_merge_hits", f"""
WITH {CHUNKS_SQL}, sub AS (
  SELECT q.vec_id // 3 AS query_id, q.vec_id % 3 AS sub_query, c.vec_id AS chunk_id, round({cosine_sql('q.e', 'c.e')}, 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cosine_sql('q.e', 'c.e')}, 6) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON c.vec_id <> q.vec_id)
SELECT query_id, chunk_id, min(sub_query) AS sub_query, min_by(rank, sub_query) AS rank, min_by(score, sub_query) AS score FROM sub WHERE rank <= 20 GROUP BY 1, 2
""")
def set1(spark, sf_dir):
    return retrieval.merge_hits(sub_hits(spark, sf_dir))


def sub_hits(spark, sf_dir):
    """Hits of three sub-queries per query."""
    rows = table(spark, sf_dir, "embeddings")
    hits = nearest(
        asked(spark, sf_dir), rows.withColumnRenamed("vec_id", "chunk_id"), 20, base_id="chunk_id", vec="embedding", exclude_self=True
    )
    return hits.select(
        F.floor(F.col("query_id") / 3).alias("query_id"), (F.col("query_id") % 3).alias("sub_query"), "chunk_id", "score", "rank"
    )


HITS_SQL = f"""
{CHUNKS_SQL}, hits AS (SELECT * FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round({cosine_sql('q.e', 'c.e')}, 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cosine_sql('q.e', 'c.e')}, 6) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON c.vec_id <> q.vec_id) WHERE rank <= 20)
"""


def hits(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return nearest(asked(spark, sf_dir), rows.withColumnRenamed("vec_id", "chunk_id"), 20, base_id="chunk_id", vec="embedding", exclude_self=True)


@query("top3_rerank", f"""
WITH {HITS_SQL}, scored AS (SELECT *, (query_id * 31 + chunk_id * 17) % 101 / 101.0 AS rerank_score FROM hits),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rerank_rank FROM scored)
SELECT query_id, chunk_id, rerank_rank FROM ranked WHERE rerank_rank <= 10
""")
def top3(spark, sf_dir):
    scored = hits(spark, sf_dir).withColumn("rerank_score", (F.col("query_id") * 31 + F.col("chunk_id") * 17) % 101 / 101)
    return retrieval.rerank(scored).select("query_id", "chunk_id", "rerank_rank")


@query("udf2_score_pairs", r"""
WITH w AS (SELECT conv_id, turn, role, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS words FROM conversations)
SELECT a.conv_id, a.turn, round(len(list_intersect(a.words, b.words)) / len(a.words), 6) AS score
FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE len(a.words) > 0
UNION ALL SELECT a.conv_id, a.turn, 0.0 FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE len(a.words) = 0
""")
def udf2(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    answer = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    scored = score_pairs(talk.join(answer, ["conv_id", "turn"]), "text", "answer", shared_words)
    return scored.select("conv_id", "turn", F.round("score", 6).alias("score"))


@query("flt15_relevance_gate", f"""
WITH {HITS_SQL} SELECT h.query_id, h.chunk_id, CASE WHEN l.quality = 1 THEN 'relevant' ELSE 'ambiguous' END AS grade
FROM hits h LEFT JOIN labels l ON l.doc_id = h.chunk_id WHERE coalesce(l.toxic, 0) <> 1
""")
def flt15(spark, sf_dir):
    grades = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("chunk_id"), F.when(F.col("toxic") == 1, "irrelevant").when(F.col("quality") == 1, "relevant").otherwise("ambiguous").alias("grade")
    )
    return retrieval.relevance_gate(hits(spark, sf_dir), grades, ("chunk_id",)).select("query_id", "chunk_id", "grade")


META_SQL = """
meta AS (
  SELECT doc_id, lang, ['IN', upper(lang)] AS jurisdiction, CASE doc_id % 3 WHEN 0 THEN 'case_law' WHEN 1 THEN 'statute' ELSE 'contract' END AS doc_type,
         ['t' || doc_id % 4, source] AS tags, DATE '2020-01-01' + CAST(doc_id % 700 AS INTEGER) AS date FROM documents)
"""


def metadata(spark, sf_dir):
    number = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.array(F.lit("IN"), F.upper("lang")).alias("jurisdiction"),
        F.when(number % 3 == 0, "case_law").when(number % 3 == 1, "statute").otherwise("contract").alias("doc_type"),
        F.array(F.concat(F.lit("t"), number % 4), "source").alias("tags"), F.date_add(F.lit("2020-01-01").cast("date"), (number % 700).cast("int")).alias("date"),
    )


@query("flt6_card_filter", f"""
WITH {META_SQL} SELECT doc_id FROM meta WHERE list_has_any(jurisdiction, ['FR', 'DE']) AND doc_type = 'statute' AND date >= DATE '2020-06-01'
""")
def flt6(spark, sf_dir):
    spec = retrieval.card_filter(jurisdiction=["FR", "DE"], doc_type="statute", tags=[], date_from="2020-06-01")
    return retrieval.apply_filter(metadata(spark, sf_dir), spec).select("doc_id")


@query("flt7_apply_filter", f"""
WITH {META_SQL} SELECT doc_id FROM meta WHERE lang IN ('en', 'es') AND list_contains(tags, 'src3') AND date BETWEEN DATE '2020-02-01' AND DATE '2021-06-30'
""")
def flt7(spark, sf_dir):
    spec = {"lang": ["en", "es"], "tags": "src3", "date": {"gte": "2020-02-01", "lte": "2021-06-30"}}
    return retrieval.apply_filter(metadata(spark, sf_dir), spec).select("doc_id")


@query("flt8_merge_filter", f"""
WITH {META_SQL} SELECT doc_id FROM meta WHERE list_contains(jurisdiction, 'EN') AND doc_type = 'contract' AND list_contains(tags, 't2')
""")
def flt8(spark, sf_dir):
    base = retrieval.card_filter(jurisdiction=["FR"], doc_type="contract")
    spec = retrieval.merge_filter(base, {"jurisdiction": "EN", "tags": "t2"})
    return retrieval.apply_filter(metadata(spark, sf_dir), spec).select("doc_id")


@query("flt9_namespace", """
SELECT doc_id FROM documents WHERE starts_with(upper(lang) || ':' || upper(source), 'EN:SRC1')
""")
def flt9(spark, sf_dir):
    return retrieval.in_namespace(legal_documents(spark, sf_dir), "EN:SRC1").select("doc_id")


GROUND_SQL = f"""
{CHUNKS_SQL}, best AS (
  SELECT s.label AS answer_id, s.vec_id AS sentence_id, c.vec_id AS chunk_id, c.document_id || ' | p.' || c.vec_id AS citation, round({cosine_sql('s.e', 'c.e')}, 6) AS score,
         row_number() OVER (PARTITION BY s.vec_id ORDER BY round({cosine_sql('s.e', 'c.e')}, 6) DESC, c.vec_id) AS r
  FROM v s JOIN v c ON c.label = s.label AND c.vec_id % 2 = 0 WHERE s.vec_id % 2 = 1),
claims AS (SELECT *, greatest(score, 0) >= 0.3 AS grounded FROM best WHERE r = 1)
"""


def claims(spark, sf_dir):
    """Odd vectors are answer sentences, even ones chunks; the label is the answer."""
    rows = chunks(spark, sf_dir).withColumn("answer_id", F.col("label"))
    said = rows.where("chunk_id % 2 = 1").select(
        "answer_id", F.col("chunk_id").alias("sentence_id"), F.concat(F.lit("s"), "chunk_id").alias("sentence"), "embedding"
    )
    stored = rows.where("chunk_id % 2 = 0").select("answer_id", "chunk_id", "citation", "embedding")
    return retrieval.ground(said, stored, 0.3), rows


@query("dec11_ground", f"WITH {GROUND_SQL} SELECT CAST(answer_id AS BIGINT) AS answer_id, sentence_id, chunk_id, citation, round(score, 4) AS similarity, grounded FROM claims")
def dec11(spark, sf_dir):
    return claims(spark, sf_dir)[0].select(
        F.col("answer_id").cast("bigint").alias("answer_id"), "sentence_id", "chunk_id", "citation", "similarity", "grounded"
    )


@query("dec11_grounded_text", f"""
WITH {GROUND_SQL} SELECT CAST(answer_id AS BIGINT) AS answer_id, coalesce(string_agg('s' || sentence_id, ' ' ORDER BY sentence_id) FILTER (WHERE grounded), '') AS grounded_answer FROM claims GROUP BY 1
""")
def dec11_text(spark, sf_dir):
    return retrieval.grounded_text(claims(spark, sf_dir)[0]).withColumn("answer_id", F.col("answer_id").cast("bigint"))


@query("agg10_faithfulness", f"""
WITH {GROUND_SQL}, answers AS (SELECT DISTINCT label AS answer_id FROM v UNION SELECT DISTINCT label + 100 FROM v)
SELECT CAST(a.answer_id AS BIGINT) AS answer_id, round(coalesce(avg(CASE WHEN grounded THEN 1.0 WHEN NOT grounded THEN 0.0 END), 1.0), 6) AS faithfulness, count(c.sentence_id) AS claims
FROM answers a LEFT JOIN claims c ON c.answer_id = a.answer_id GROUP BY 1
""")
def agg10(spark, sf_dir):
    found, rows = claims(spark, sf_dir)
    answers = rows.select(F.explode(F.array("label", F.col("label") + 100)).alias("answer_id"))
    return retrieval.faithfulness(answers, found).select(
        F.col("answer_id").cast("bigint").alias("answer_id"), F.round("faithfulness", 6).alias("faithfulness"), "claims"
    )


@query("txt22_context_block", f"""
WITH {HITS_SQL}
SELECT query_id, string_agg('[Context ' || rank || '] Citation: D' || chunk_id % 25 || ' | p.' || chunk_id || chr(10) || 'text ' || chunk_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM hits WHERE rank <= 10 GROUP BY 1
""")
def txt22(spark, sf_dir):
    rows = chunks(spark, sf_dir).select("chunk_id", "citation", F.concat(F.lit("text "), "chunk_id").alias("text"))
    return retrieval.context_block(hits(spark, sf_dir).join(rows, "chunk_id"))


@query("txt22_evidence_pool", """
WITH ranked AS (SELECT user_id AS query_id, event_id, props, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events)
SELECT query_id, 'EVIDENCE POOL:' || chr(10) || string_agg(chr(10) || '[SOURCE_' || n || '] (' || CASE WHEN value > 100 THEN 'HIGH' ELSE 'LOW' END || ' confidence, source: ' || event_type || '):' || chr(10) || props, chr(10) ORDER BY n) AS pool
FROM ranked WHERE n <= 50 GROUP BY 1
""")
def txt22_pool(spark, sf_dir):
    items = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("source_id"), F.col("props").alias("content"),
        F.col("event_type").alias("source_type"), F.col("value").alias("confidence"), F.when(F.col("value") > 100, "HIGH").otherwise("LOW").alias("tier"),
    )
    return retrieval.evidence_pool(items)


@query("num7_similarity_filter", f"""
WITH {CHUNKS_SQL}, p AS (
  SELECT a.vec_id, a.vec_id % 7 = 0 AS blank, a.e AS x, CASE WHEN a.vec_id % 5 = 0 THEN a.e ELSE b.e END AS y FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(CASE WHEN blank THEN 0.0 ELSE {cosine_sql('x', 'y')} END, 6) AS similarity, NOT blank AND {cosine_sql('x', 'y')} >= 0.95 AS skip FROM p
""")
def num7(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("_next"))
    pairs = rows.join(following, "vec_id").withColumn(
        "new", F.when(F.col("vec_id") % 5 == 0, F.col("embedding")).otherwise(F.col("_next"))
    ).withColumn("old_text", F.when(F.col("vec_id") % 7 == 0, "  ").otherwise("a")).withColumn("new_text", F.lit("b"))
    done = retrieval.similarity_filter(pairs, "embedding", "new", "old_text", "new_text", 0.95)
    return done.select("vec_id", F.round("similarity", 6).alias("similarity"), "skip")


BATCH_SQL = f"""
{CHUNKS_SQL}, sub AS (SELECT vec_id // 3 AS query_id, vec_id % 3 AS sub_query, vec_id, e FROM v),
matched AS (SELECT * FROM (SELECT q.vec_id, c.document_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cosine_sql('q.e', 'c.e')}, 6) DESC, c.document_id) AS r FROM sub q, cards c) WHERE r <= 5),
tier2 AS (SELECT * FROM (
  SELECT q.query_id, q.sub_query, c.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cosine_sql('q.e', 'c.e')}, 6) DESC, c.vec_id) AS rank
  FROM matched m JOIN sub q ON q.vec_id = m.vec_id JOIN v c ON c.document_id = m.document_id) WHERE rank <= 20),
merged AS (SELECT query_id, chunk_id FROM tier2 GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (query_id * 31 + chunk_id * 17) % 101 DESC, chunk_id) AS r FROM merged) WHERE r <= 10),
passed AS (SELECT t.query_id, t.chunk_id FROM top t LEFT JOIN labels l ON l.doc_id = t.chunk_id WHERE coalesce(l.toxic, 0) <> 1),
said AS (SELECT vec_id // 3 AS query_id, vec_id AS sentence_id, e FROM v),
claims AS (SELECT s.query_id, s.sentence_id, greatest(0, max(round({cosine_sql('s.e', 'c.e')}, 6))) >= 0.2 AS grounded
  FROM said s JOIN passed p ON p.query_id = s.query_id JOIN v c ON c.vec_id = p.chunk_id GROUP BY 1, 2)
SELECT q.query_id, (SELECT count(*) FROM merged m WHERE m.query_id = q.query_id) AS retrieved, (SELECT count(*) FROM passed p WHERE p.query_id = q.query_id) AS passed,
       round(coalesce((SELECT avg(CASE WHEN grounded THEN 1.0 ELSE 0.0 END) FROM claims c WHERE c.query_id = q.query_id), 1.0), 6) AS faithfulness
FROM (SELECT DISTINCT query_id FROM sub) q
"""


@query("dec17_answer_batch", f"WITH {BATCH_SQL}")
def dec17(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    sub = rows.select(F.floor(F.col("chunk_id") / 3).alias("query_id"), (F.col("chunk_id") % 3).alias("sub_query"), "embedding")
    said = rows.select(F.floor(F.col("chunk_id") / 3).alias("answer_id"), F.col("chunk_id").alias("sentence_id"), "embedding")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id"))
    cfg = replace(RETRIEVAL, card_top_k=5, chunk_top_k=20, faithfulness_threshold=0.2)

    def score(pairs):
        return pairs.withColumn("rerank_score", (F.col("query_id") * 31 + F.col("chunk_id") * 17) % 101)

    done = retrieval.answer_batch(
        sub.select("query_id").distinct(), sub, cards(spark, sf_dir), rows,
        toxic.withColumn("grade", F.lit("irrelevant")), said, score, cfg=cfg, grade_keys=("chunk_id",),
    )
    return done.select("query_id", "retrieved", "passed", F.round("faithfulness", 6).alias("faithfulness"))
