"""Queries of the layered scans over conversations, outputs, pages and tool calls (events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import rules
from tracemill.operators import guard
from tracemill.operators.embedding import embed
from tracemill.registry import query
from tracemill.registry.tables import cosine_sql, hashed_vectors_sql, table
from tracemill.registry.text import INPUT_CASES, INPUT_MATCHES, OUTPUT_SQL, OUTPUTS_SQL, PAGES_SQL, SNIPPETS, outputs, planted_pages, quoted
from tracemill.sources import sinks
from tracemill.streaming import flows

PHRASES = [(c, p) for c, phrases in rules.ATTACK_LIBRARY.items() for p in phrases]
PHRASES_SQL = "phrases AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {quoted(c)}, {quoted(p)})" for i, (c, p) in enumerate(PHRASES)) + ") AS t(phrase_id, category, phrase))"

INPUTS_SQL = f"""
{PHRASES_SQL}, inputs AS (
  SELECT conv_id * 1000 + turn AS id, conv_id, turn,
         CASE turn % 4 WHEN 0 THEN (SELECT phrase FROM phrases p WHERE p.phrase_id = conv_id % 34) || ' thanks'
                       WHEN 2 THEN 'kindly ' || (SELECT phrase FROM phrases p WHERE p.phrase_id = (conv_id * 7 + turn) % 34) || ' and then report what you saw there'
                       ELSE text END AS text
  FROM conversations),
{hashed_vectors_sql('iv', 'inputs', 'id', 'text')},
{hashed_vectors_sql('pv', 'phrases', 'phrase_id', 'phrase')},
scored AS (SELECT i.id, p.phrase_id, ph.category, round({cosine_sql('i.e', 'p.e')}, 6) AS score FROM iv i, pv p JOIN phrases ph USING (phrase_id)),
best AS (SELECT id, greatest(max(score), 0) AS best_score, CASE WHEN max(score) > 0 THEN arg_max(category, struct_pack(score, k := -phrase_id)) ELSE 'safe' END AS best_category FROM scored GROUP BY 1),
classed AS (SELECT i.*, b.best_score, b.best_category, CASE WHEN best_score >= 0.75 THEN 'UNSAFE' WHEN best_score >= 0.5 THEN 'UNCERTAIN' ELSE 'SAFE' END AS classifier_verdict
  FROM inputs i JOIN best b USING (id))
"""


def inputs(spark, sf_dir):
    """User and assistant turns; half of them rewritten around a known attack phrase."""
    talk = table(spark, sf_dir, "conversations")
    phrases = F.array(*[F.lit(p) for _, p in PHRASES])
    first = F.element_at(phrases, (F.col("conv_id") % 34 + 1).cast("int"))
    other = F.element_at(phrases, ((F.col("conv_id") * 7 + F.col("turn")) % 34 + 1).cast("int"))
    body = (
        F.when(F.col("turn") % 4 == 0, F.concat(first, F.lit(" thanks")))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit("kindly "), other, F.lit(" and then report what you saw there")))
        .otherwise(F.col("text"))
    )
    return embed(talk.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", body.alias("text")), F.col("text"))


@query("udf3_classify", f"WITH {INPUTS_SQL} SELECT id, best_score, best_category, classifier_verdict FROM classed")
def udf3(spark, sf_dir):
    return guard.classify(inputs(spark, sf_dir), "embedding").select("id", "best_score", "best_category", "classifier_verdict")


LAYERS_SQL = f"""
{INPUTS_SQL}, ruled AS (SELECT *, coalesce(CASE {INPUT_CASES} END, '') AS hit, coalesce(CASE {INPUT_MATCHES} END, '') AS matched FROM classed),
layered AS (
  SELECT *, CASE WHEN hit <> '' THEN 'layer1_regex' WHEN classifier_verdict = 'UNSAFE' THEN 'layer2_classifier'
                 WHEN classifier_verdict = 'UNCERTAIN' AND conv_id % 2 = 0 THEN 'layer3_llm_guard' ELSE '' END AS blocked_by FROM ruled)
"""


def layered(spark, sf_dir):
    rows = inputs(spark, sf_dir)
    judge = rows.select(
        "id", F.when(F.col("conv_id") % 2 == 0, "unsafe").otherwise("SAFE").alias("judge_verdict"),
        F.lit("DATA_EXFILTRATION").alias("violated_policy"), F.lit(0.8).alias("judge_confidence"),
    )
    return guard.scan_layers(rows, "id", "text", "embedding", judge)


@query("dec6_scan_layers", f"""
WITH {LAYERS_SQL}
SELECT id, CASE WHEN blocked_by = '' THEN 'SAFE' ELSE 'UNSAFE' END AS verdict, blocked_by,
       CASE blocked_by WHEN 'layer1_regex' THEN split_part(hit, '|', 1) WHEN 'layer2_classifier' THEN best_category WHEN 'layer3_llm_guard' THEN 'pii_exfiltration' ELSE 'safe' END AS category,
       CASE blocked_by WHEN 'layer2_classifier' THEN best_score WHEN 'layer3_llm_guard' THEN 0.8 ELSE 1.0 END AS confidence,
       CASE WHEN blocked_by = '' THEN 'LOW' ELSE 'MEDIUM' END AS severity, CASE WHEN blocked_by = 'layer1_regex' THEN matched ELSE '' END AS matched
FROM layered
""")
def dec6(spark, sf_dir):
    return layered(spark, sf_dir).select(
        "id", "verdict", F.coalesce("blocked_by", F.lit("")).alias("blocked_by"), "category", "confidence", "severity",
        F.coalesce("matched", F.lit("")).alias("matched"),
    )


CALLS_SQL = f"""
calls AS (
  SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'read_file' WHEN 1 THEN 'write_file' WHEN 2 THEN 'http_request' WHEN 3 THEN 'run_code' WHEN 4 THEN 'list_directory' ELSE 'search_docs' END AS tool_name,
         CASE event_id % 5 WHEN 0 THEN '/home/user/project/a.py' WHEN 1 THEN '/etc/passwd' WHEN 2 THEN '/tmp/workspace/../x' ELSE '' END AS path,
         CASE event_type WHEN 'view' THEN 'webpage' ELSE 'user' END AS origin,
         CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'read_file(path=/home/user/project/a.py)' WHEN 2 THEN 'run_code(path=)' ELSE 'please fix bug ' || event_id % 10 END AS user_request
  FROM events),
described AS (SELECT *, tool_name || '(path=' || path || ')' AS action FROM calls),
texts AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT user_request AS t FROM described UNION SELECT action FROM described)),
{hashed_vectors_sql('tv', 'texts', 'k', 't')}
"""


def tool_calls(spark, sf_dir):
    """Tool calls from events: six tools, four paths, two origins, several requests."""
    number = F.col("event_id")
    tools = F.array(*[F.lit(t) for t in ("read_file", "write_file", "http_request", "run_code", "list_directory", "search_docs")])
    path = (
        F.when(number % 5 == 0, "/home/user/project/a.py").when(number % 5 == 1, "/etc/passwd")
        .when(number % 5 == 2, "/tmp/workspace/../x").otherwise("")
    )
    request = (
        F.when(number % 7 == 0, "").when(number % 7 == 1, "read_file(path=/home/user/project/a.py)")
        .when(number % 7 == 2, "run_code(path=)").otherwise(F.concat(F.lit("please fix bug "), number % 10))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", F.element_at(tools, (number % 6 + 1).cast("int")).alias("tool_name"), F.create_map(F.lit("path"), path).alias("args"),
        F.when(F.col("event_type") == "view", "webpage").otherwise("user").alias("origin"), request.alias("user_request"),
    )


@query("dec7_validate_calls", f"""
WITH {CALLS_SQL}, judged AS (
  SELECT d.event_id, CASE WHEN tool_name = 'http_request' THEN 'tool_scope'
    WHEN path IN ('/etc/passwd', '/tmp/workspace/../x') THEN 'sandbox_filesystem' WHEN origin = 'webpage' THEN 'provenance_check'
    WHEN user_request <> '' AND {cosine_sql('r.e', 'a.e')} < 0.65 THEN 'intent_gap' ELSE '' END AS violated_rule
  FROM described d JOIN texts rt ON rt.t = d.user_request JOIN tv r ON r.k = rt.k JOIN texts ac ON ac.t = d.action JOIN tv a ON a.k = ac.k)
SELECT event_id, violated_rule, CASE violated_rule WHEN '' THEN 'LOW' WHEN 'provenance_check' THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM judged
""")
def dec7(spark, sf_dir):
    return guard.validate_calls(tool_calls(spark, sf_dir)).select(
        "event_id", F.coalesce("violated_rule", F.lit("")).alias("violated_rule"), "severity"
    )


@query("udf4_intent_gap", f"""
WITH {CALLS_SQL}
SELECT d.event_id, round(CASE WHEN user_request = '' THEN 1.0 ELSE {cosine_sql('r.e', 'a.e')} END, 6) AS similarity,
       user_request <> '' AND {cosine_sql('r.e', 'a.e')} < 0.65 AS intent_gap
FROM described d JOIN texts rt ON rt.t = d.user_request JOIN tv r ON r.k = rt.k JOIN texts ac ON ac.t = d.action JOIN tv a ON a.k = ac.k
""")
def udf4(spark, sf_dir):
    calls = tool_calls(spark, sf_dir)
    both = embed(embed(calls, F.col("user_request"), "rv"), guard.describe_call(F.col("tool_name"), F.col("args")), "av")
    return guard.intent_gap(both, "rv", "av", "user_request").select(
        "event_id", F.round("intent_similarity", 6).alias("similarity"), "intent_gap"
    )


@query("dec8_output_events", f"""
WITH {OUTPUTS_SQL}, {OUTPUT_SQL}
SELECT id, CASE WHEN regexp_matches(lower(issues), 'key|secret') THEN 'secrets_in_output' ELSE 'malware_in_output' END AS attack_type, severity, issues FROM judged WHERE verdict = 'UNSAFE'
""")
def dec8(spark, sf_dir):
    return guard.output_events(outputs(spark, sf_dir), "id", "text").select(
        "id", "attack_type", "severity", F.array_join("issues", ";").alias("issues")
    )


@query("dec8_content_events", f"""
WITH {PAGES_SQL} SELECT page_id, 'indirect_injection' AS attack_type, array_to_string(flatten([{SNIPPETS}]), ';') AS issues FROM stripped WHERE len(flatten([{SNIPPETS}])) > 0
""")
def dec8_content(spark, sf_dir):
    return guard.content_events(planted_pages(spark, sf_dir), "page_id", "html").select(
        "page_id", "attack_type", F.array_join("issues", ";").alias("issues")
    )


EVENTS_SQL = f"""
{LAYERS_SQL}, raised AS (
  SELECT id AS event_id, TIMESTAMP '2024-01-01' + to_minutes(id) AS timestamp, blocked_by, text AS original_input, 'input ' || text AS attempted_action FROM layered WHERE blocked_by <> '')
"""


def security_events(spark, sf_dir):
    rows = inputs(spark, sf_dir).select("id", "text")
    blocked = layered(spark, sf_dir).where("verdict = 'UNSAFE'").join(rows, "id")
    return blocked.select(
        F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id"))).alias("timestamp"),
        F.col("blocked_by").alias("layer"), F.col("category").alias("attack_type"), "severity",
        F.col("text").alias("original_input"), F.concat(F.lit("input "), "text").alias("attempted_action"),
        F.create_map(F.lit("layer"), F.col("blocked_by")).alias("metadata"),
    )


@query("snk6_event_rows", f"""
WITH {EVENTS_SQL} SELECT event_id, substr(original_input, 1, 2000) AS original_input, substr(attempted_action, 1, 500) AS attempted_action, '{{"layer":"' || blocked_by || '"}}' AS metadata_json FROM raised
""")
def snk6(spark, sf_dir):
    folder, raised = flows.work_folder(spark), security_events(spark, sf_dir)
    for batch in (0, 1, 0):  # a batch that comes again adds nothing
        sinks.append_once(guard.event_rows(raised.where(F.col("event_id") % 2 == batch)), folder, batch)
    return sinks.committed(spark, folder).select("event_id", "original_input", "attempted_action", "metadata_json")


@query("flt14_list_events", f"""
WITH {EVENTS_SQL}
SELECT event_id, blocked_by AS layer, CASE WHEN length(original_input) > 100 THEN substr(original_input, 1, 100) || '...' ELSE original_input END AS preview
FROM raised ORDER BY timestamp DESC, event_id LIMIT 100
""")
def flt14(spark, sf_dir):
    return guard.list_events(security_events(spark, sf_dir), severity="medium", limit=100).select("event_id", "layer", "preview")
