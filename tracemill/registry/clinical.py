"""Queries over clinical records (events: patient = user; views and clicks are labs, the rest entities)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import dates, scores, text
from tracemill.operators import clinical, graph, retrieval
from tracemill.plans import patients
from tracemill.registry import query
from tracemill.registry.tables import cosine_sql, table
from tracemill.registry.text import quoted

DRUGS = (
    "Metformin", "lisinopril", "ibuprofen", "warfarin", "aspirin", "spironolactone", "sertraline", "tramadol",
    "simvastatin", "gemfibrozil", "ciprofloxacin", "antacid", "iodinated-contrast", "vitamin d",
)
AS_OF = "2024-01-31"

REF_SQL = "ref AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', {lo}, {hi}, '{u}', '{c}')" for k, lo, hi, u, c in clinical.LAB_REFERENCE) + ") AS t(test_key, low, high, ref_unit, loinc))"

LABS_SQL = f"""
{REF_SQL}, labs AS (
  SELECT event_id AS lab_id, user_id AS patient_id, ts, CASE event_id % 5 WHEN 0 THEN 'eGFR' WHEN 1 THEN 'creatinine' WHEN 2 THEN 'Total Cholesterol' WHEN 3 THEN 'hba1c' ELSE 'mystery' END AS test_name,
         CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN value / 50 WHEN 2 THEN value * 4 WHEN 3 THEN value / 8 ELSE value END AS value, '' AS unit
  FROM events WHERE event_type IN ('view', 'click')),
ranged AS (SELECT l.*, replace(lower(test_name), ' ', '_') AS test_key, r.low, r.high, r.ref_unit, r.loinc FROM labs l LEFT JOIN ref r ON r.test_key = replace(lower(test_name), ' ', '_')),
results AS (
  SELECT *, coalesce(NOT (value BETWEEN low AND high), false) AS abnormal,
         CASE WHEN low IS NULL OR value BETWEEN low AND high THEN 'normal'
              ELSE CASE WHEN greatest(CASE WHEN low > 0 THEN (low - value) / low ELSE 0 END, CASE WHEN high > 0 THEN (value - high) / high ELSE 0 END) > 0.5 THEN 'critical'
                        WHEN greatest(CASE WHEN low > 0 THEN (low - value) / low ELSE 0 END, CASE WHEN high > 0 THEN (value - high) / high ELSE 0 END) > 0.3 THEN 'high'
                        WHEN greatest(CASE WHEN low > 0 THEN (low - value) / low ELSE 0 END, CASE WHEN high > 0 THEN (value - high) / high ELSE 0 END) > 0.1 THEN 'moderate' ELSE 'low' END END AS severity
  FROM ranged)
"""


def labs(spark, sf_dir):
    number, value = F.col("event_id") % 5, F.col("value").cast("double")
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click")).select(
        F.col("event_id").alias("lab_id"), F.col("user_id").alias("patient_id"), "ts",
        F.when(number == 0, "eGFR").when(number == 1, "creatinine").when(number == 2, "Total Cholesterol").when(number == 3, "hba1c").otherwise("mystery").alias("test_name"),
        F.when(number == 1, value / 50).when(number == 2, value * 4).when(number == 3, value / 8).otherwise(value).alias("value"),
        F.lit("").alias("unit"), F.lit(None).cast("double").alias("previous_value"),
    )


def results(spark, sf_dir):
    return clinical.lab_results(labs(spark, sf_dir), clinical.reference_table(spark))


@query("joi13_lab_reference", f"WITH {LABS_SQL} SELECT lab_id, test_key, coalesce(low, -1) AS low, coalesce(high, -1) AS high, coalesce(loinc, '') AS loinc FROM ranged")
def joi13(spark, sf_dir):
    ranged = clinical.lab_reference(labs(spark, sf_dir), clinical.reference_table(spark))
    return ranged.select(
        "lab_id", "test_key", F.coalesce("low", F.lit(-1.0)).alias("low"), F.coalesce("high", F.lit(-1.0)).alias("high"), F.coalesce("loinc", F.lit("")).alias("loinc")
    )


@query("num4_lab_severity", f"WITH {LABS_SQL} SELECT lab_id, abnormal, severity, coalesce(ref_unit, '') AS unit FROM results")
def num4(spark, sf_dir):
    return results(spark, sf_dir).select("lab_id", "abnormal", "severity", "unit")


@query("agg11_finding_rollup", f"""
WITH {LABS_SQL}, s AS (
  SELECT patient_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, abnormal, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rank,
         CASE WHEN abnormal AND test_key IN ('egfr', 'creatinine') THEN 'nephrology' WHEN abnormal AND test_key = 'total_cholesterol' THEN 'cardiology' WHEN abnormal AND test_key = 'hba1c' THEN 'endocrinology' END AS flag FROM results)
SELECT patient_id, day, bool_or(abnormal) AS abnormal, ['normal', 'low', 'moderate', 'high', 'critical'][max(rank) + 1] AS severity, coalesce(string_agg(DISTINCT flag, ',' ORDER BY flag), '') AS specialists FROM s GROUP BY 1, 2
""")
def agg11(spark, sf_dir):
    rolled = clinical.finding_rollup(results(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string")), "patient_id", "day")
    return rolled.withColumn("specialists", F.array_join("specialists", ","))


DELTAS_SQL = f"""
{LABS_SQL}, linked AS (
  SELECT *, lag(value) OVER w AS previous, lag(ts) OVER w AS prev_ts, lead(lab_id) OVER w AS next_lab, lead(ts) OVER w AS next_ts FROM labs WINDOW w AS (PARTITION BY patient_id, test_name ORDER BY ts, lab_id))
"""


@query("win7_lab_edges", f"WITH {DELTAS_SQL} SELECT lab_id AS from_lab, next_lab AS to_lab, date_diff('day', CAST(ts AS DATE), CAST(next_ts AS DATE)) AS gap_days FROM linked WHERE next_lab IS NOT NULL")
def win7(spark, sf_dir):
    return clinical.lab_edges(labs(spark, sf_dir)).select("from_lab", "to_lab", F.col("gap_days").cast("bigint").alias("gap_days"))


@query("win8_lab_deltas", f"WITH {DELTAS_SQL} SELECT lab_id, round(previous, 6) AS previous, round(value, 6) AS current, round(value - previous, 6) AS delta, date_diff('day', CAST(prev_ts AS DATE), CAST(ts AS DATE)) AS days_between FROM linked WHERE previous IS NOT NULL")
def win8(spark, sf_dir):
    return clinical.lab_deltas(labs(spark, sf_dir)).select(
        "lab_id", *[F.round(c, 6).alias(c) for c in ("previous", "current", "delta")], F.col("days_between").cast("bigint").alias("days_between")
    )


@query("win9_lab_trend", f"""
WITH {LABS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY ts DESC, lab_id DESC) AS back FROM labs WHERE lower(test_name) = 'egfr')
SELECT patient_id, lab_id, round(value, 6) AS value FROM ranked WHERE back <= 3
""")
def win9(spark, sf_dir):
    return clinical.lab_trend(labs(spark, sf_dir), "EGFR", 3).select("patient_id", "lab_id", F.round("value", 6).alias("value"))


@query("win9_latest_labs", f"WITH {LABS_SQL} SELECT patient_id, test_name, round(max_by(value, struct_pack(ts, lab_id)), 6) AS value FROM labs GROUP BY 1, 2")
def win9_latest(spark, sf_dir):
    return clinical.latest_labs(labs(spark, sf_dir)).select("patient_id", "test_name", F.round("value", 6).alias("value"))


DRUG_LIST = "[" + ", ".join(quoted(d) for d in DRUGS) + "]"
ENTITIES_SQL = f"""
keyed AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
entities AS (
  SELECT event_id, user_id AS patient_id, CAST(ts AS DATE) AS finding_date, CASE event_type WHEN 'purchase' THEN 'DRUG' WHEN 'error' THEN 'CONDITION' ELSE 'SYMPTOM' END AS entity_type,
         CASE event_type WHEN 'purchase' THEN {DRUG_LIST}[k % {len(DRUGS)} + 1] WHEN 'error' THEN 'Condition ' || k % 7 ELSE 'Symptom ' || k % 5 END AS value,
         CASE WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'RX' || k % {len(DRUGS)} WHEN event_type = 'error' THEN 'E' || 10 + k % 7 END AS code
  FROM keyed WHERE event_type IN ('purchase', 'error', 'signup'))
"""


def entities(spark, sf_dir):
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    drugs = F.array(*[F.lit(d) for d in DRUGS])
    return table(spark, sf_dir, "events").where(kind.isin("purchase", "error", "signup")).select(
        "event_id", F.col("user_id").alias("patient_id"), F.to_date("ts").alias("finding_date"),
        F.when(kind == "purchase", "DRUG").when(kind == "error", "CONDITION").otherwise("SYMPTOM").alias("entity_type"),
        F.when(kind == "purchase", F.element_at(drugs, k % len(DRUGS) + 1)).when(kind == "error", F.concat(F.lit("Condition "), k % 7))
        .otherwise(F.concat(F.lit("Symptom "), k % 5)).alias("value"),
        F.when((kind == "purchase") & (k % 2 == 0), F.concat(F.lit("RX"), k % len(DRUGS))).when(kind == "error", F.concat(F.lit("E"), k % 7 + 10)).alias("code"),
    )


def built(spark, sf_dir):
    return graph.build_graph(entities(spark, sf_dir), results(spark, sf_dir))


GRAPH_SQL = f"""
{ENTITIES_SQL}, {LABS_SQL}, named AS (
  SELECT *, lower(entity_type) AS kind, substr(sha256(patient_id || ':' || lower(entity_type) || ':' || lower(value)), 1, 16) AS own FROM entities),
placed AS (SELECT *, CASE WHEN kind = 'drug' THEN coalesce(code, own) ELSE own END AS node_id FROM named),
ent_nodes AS (
  SELECT node_id, kind, CASE WHEN kind = 'drug' THEN max_by(value, struct_pack(finding_date, value)) ELSE min_by(value, struct_pack(finding_date, value)) END AS name,
         coalesce(CASE WHEN kind = 'drug' THEN max_by(code, struct_pack(finding_date, value)) ELSE min_by(code, struct_pack(finding_date, value)) END, '') AS code FROM placed GROUP BY 1, 2),
lab_placed AS (SELECT *, CAST(ts AS DATE) AS date, substr(sha256(patient_id || ':lab:' || lower(test_name || ':' || CAST(CAST(ts AS DATE) AS VARCHAR))), 1, 16) AS node_id FROM results),
lab_nodes AS (SELECT node_id, max_by(test_name, struct_pack(ts, lab_id)) AS name, max_by(value, struct_pack(ts, lab_id)) AS value, any_value(date) AS date, any_value(patient_id) AS patient_id, coalesce(any_value(ref_unit), '') AS unit FROM lab_placed GROUP BY 1),
edges AS (
  SELECT DISTINCT patient_id, node_id, CASE kind WHEN 'drug' THEN 'PRESCRIBED' WHEN 'condition' THEN 'DIAGNOSED_WITH' ELSE 'HAS_SYMPTOM' END AS edge, finding_date AS date FROM placed
  UNION SELECT DISTINCT patient_id, node_id, 'HAS_LAB', date FROM lab_placed)
"""


@query("dec14_graph", f"""
WITH {GRAPH_SQL}
SELECT node_id, kind, name, code, -1.0 AS value, '' AS date FROM ent_nodes
UNION ALL SELECT node_id, 'lab', name, '', round(value, 6), CAST(date AS VARCHAR) FROM lab_nodes
UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR), 'patient', CAST(user_id AS VARCHAR), '', -1.0, '' FROM events
""")
def dec14(spark, sf_dir):
    nodes, _ = built(spark, sf_dir)
    return nodes.select(
        "node_id", "kind", "name", "code", F.coalesce(F.round("value", 6), F.lit(-1.0)).alias("value"), F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date")
    )


@query("dec14_edges", f"WITH {GRAPH_SQL} SELECT patient_id, node_id, edge, CAST(date AS VARCHAR) AS date FROM edges")
def dec14_edges(spark, sf_dir):
    return built(spark, sf_dir)[1].withColumn("date", F.col("date").cast("string"))


@query("win7_preceded", f"""
WITH {GRAPH_SQL}, linked AS (SELECT node_id AS from_lab, lead(node_id) OVER w AS to_lab, date, lead(date) OVER w AS nd FROM lab_nodes WINDOW w AS (PARTITION BY patient_id, name ORDER BY date, node_id))
SELECT from_lab, to_lab, date_diff('day', date, nd) AS gap_days FROM linked WHERE to_lab IS NOT NULL
""")
def win7_graph(spark, sf_dir):
    return graph.preceded(*built(spark, sf_dir)).select("from_lab", "to_lab", F.col("gap_days").cast("bigint").alias("gap_days"))


ACTIVE_SQL = f"""
{GRAPH_SQL}, active AS (
  SELECT e.patient_id, n.name, e.date, n.node_id, row_number() OVER (PARTITION BY e.patient_id ORDER BY e.date DESC, n.name, n.node_id) AS rank FROM edges e JOIN ent_nodes n USING (node_id) WHERE e.edge = 'PRESCRIBED')
"""


@query("joi8_active_drugs", f"WITH {ACTIVE_SQL} SELECT patient_id, name, CAST(date AS VARCHAR) AS date, rank FROM active WHERE rank <= 20")
def joi8(spark, sf_dir):
    return graph.active_drugs(*built(spark, sf_dir)).select("patient_id", "name", F.col("date").cast("string").alias("date"), "rank")


@query("joi9_conditions", f"WITH {GRAPH_SQL} SELECT e.patient_id, n.name, n.code, CAST(e.date AS VARCHAR) AS date FROM edges e JOIN ent_nodes n USING (node_id) WHERE e.edge = 'DIAGNOSED_WITH'")
def joi9(spark, sf_dir):
    return graph.conditions_timeline(*built(spark, sf_dir)).select("patient_id", "name", "code", F.col("date").cast("string").alias("date"))


@query("joi10_temporal_context", f"""
WITH {GRAPH_SQL}
SELECT DISTINCT e.patient_id, CASE n.kind WHEN 'drug' THEN 'drug' ELSE 'condition' END AS type, n.name, CAST(e.date AS VARCHAR) AS date, -1.0 AS value FROM edges e JOIN ent_nodes n USING (node_id) WHERE n.kind IN ('drug', 'condition')
UNION ALL SELECT DISTINCT patient_id, 'lab', name, CAST(date AS VARCHAR), round(value, 6) FROM lab_nodes
""")
def joi10(spark, sf_dir):
    context = graph.temporal_context(*built(spark, sf_dir))
    return context.select("patient_id", "type", "name", F.col("date").cast("string").alias("date"), F.coalesce(F.round("value", 6), F.lit(-1.0)).alias("value"))


@query("joi7_drug_lab_phase", f"""
WITH {GRAPH_SQL}, days AS (SELECT DISTINCT e.patient_id, e.date FROM edges e JOIN ent_nodes n USING (node_id) WHERE e.edge = 'PRESCRIBED' AND lower(n.name) = 'metformin')
SELECT l.node_id AS lab_id, count(*) FILTER (WHERE l.date < d.date) AS before, count(*) FILTER (WHERE l.date >= d.date) AS after
FROM lab_nodes l JOIN days d ON d.patient_id = l.patient_id WHERE lower(l.name) = 'egfr' GROUP BY 1
""")
def joi7(spark, sf_dir):
    found = graph.drug_lab_phase(*built(spark, sf_dir), "metformin", "EGFR")
    return found.select("lab_id", F.col("before").cast("bigint").alias("before"), F.col("after").cast("bigint").alias("after"))


ALIAS_SQL = "aliases AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{c}')" for c, names in clinical.DRUG_ALIASES.items() for a in sorted({*names, c})) + ") AS t(name, drug_class))"
RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {quoted(a)}, {quoted(b)}, {quoted(s)}, {quoted(rec)}, {quoted(src)}, {quoted(m or '')}, {t or 0})" for i, (a, b, _, s, src, rec, m, t) in enumerate(clinical.DRUG_RULES)
) + ") AS t(rule_id, drug_a, drug_b, severity, recommendation, source, metric, threshold))"
CLASSES_SQL = f"""
{ALIAS_SQL}, taken AS (SELECT DISTINCT patient_id, replace(replace(lower(value), '-', '_'), ' ', '_') AS name FROM entities WHERE entity_type = 'DRUG'),
classes AS (SELECT patient_id, name AS drug_class FROM taken UNION SELECT patient_id, drug_class FROM taken JOIN aliases USING (name))
"""


@query("joi12_drug_classes", f"WITH {ENTITIES_SQL}, {CLASSES_SQL} SELECT patient_id, drug_class FROM classes")
def joi12(spark, sf_dir):
    drugs = entities(spark, sf_dir).where("entity_type = 'DRUG'").withColumnRenamed("value", "drug")
    return clinical.drug_classes(drugs, clinical.alias_table(spark))


INTERACTIONS_SQL = f"""
{ENTITIES_SQL}, {CLASSES_SQL}, {RULES_SQL}, {LABS_SQL}, newest AS (SELECT patient_id, max_by(value, struct_pack(ts, lab_id)) AS egfr FROM labs WHERE test_name = 'eGFR' GROUP BY 1),
warned AS (
  SELECT DISTINCT c.patient_id, r.rule_id, r.severity, CASE WHEN metric = '' THEN r.drug_b ELSE 'egfr < 30.0' END AS drug_b
  FROM classes c JOIN rules r ON r.drug_a = c.drug_class LEFT JOIN newest n ON n.patient_id = c.patient_id
  WHERE CASE WHEN metric = '' THEN EXISTS (SELECT 1 FROM classes o WHERE o.patient_id = c.patient_id AND o.drug_class = r.drug_b) ELSE coalesce(n.egfr < threshold, false) END)
"""


def interactions(spark, sf_dir):
    drugs = entities(spark, sf_dir).where("entity_type = 'DRUG'").withColumnRenamed("value", "drug")
    return clinical.interactions(drugs, clinical.latest_labs(labs(spark, sf_dir)), clinical.rule_table(spark), clinical.alias_table(spark))


@query("joi11_interactions", f"WITH {INTERACTIONS_SQL} SELECT patient_id, rule_id, severity, drug_b FROM warned")
def joi11(spark, sf_dir):
    return interactions(spark, sf_dir).select("patient_id", "rule_id", "severity", "drug_b")


@query("agg12_consults", f"""
WITH {INTERACTIONS_SQL}, flags AS (
  SELECT patient_id, CASE WHEN abnormal AND test_key IN ('egfr', 'creatinine') THEN 'nephrology' WHEN abnormal AND test_key = 'total_cholesterol' THEN 'cardiology' WHEN abnormal AND test_key = 'hba1c' THEN 'endocrinology' END AS flag FROM results
  UNION ALL SELECT patient_id, 'clinical_pharmacology' FROM warned WHERE severity = 'high')
SELECT patient_id, coalesce(string_agg(DISTINCT flag, ',' ORDER BY flag), '') AS consults FROM flags WHERE patient_id IN (SELECT patient_id FROM results) GROUP BY 1
""")
def agg12(spark, sf_dir):
    evidence = results(spark, sf_dir).withColumn("specialists", scores.lab_specialists(F.col("test_key"), F.col("abnormal")))
    return clinical.consults(evidence, interactions(spark, sf_dir)).withColumn("consults", F.array_join("consults", ","))


EVIDENCE_SQL = f"""
raw AS (
  SELECT event_id, user_id AS patient_id, CASE event_type WHEN 'click' THEN 'rxnorm_rules' WHEN 'view' THEN 'kg_traversal' WHEN 'error' THEN 'lab_parser' WHEN 'purchase' THEN 'vector_search' ELSE 'other' END AS source_type,
         least(1.0, value / 100) AS confidence, CASE WHEN event_id % 6 > 0 THEN CAST(ts AS DATE) - CAST(event_id % 900 AS INTEGER) END AS finding_date, props FROM events),
aged AS (SELECT *, date_diff('day', finding_date, DATE '{AS_OF}') AS days FROM raw),
ranked AS (
  SELECT *, least(1.0, confidence * CASE source_type WHEN 'rxnorm_rules' THEN 1.0 WHEN 'kg_traversal' THEN 0.95 WHEN 'lab_parser' THEN 0.98 WHEN 'vector_search' THEN 0.85 ELSE 0.80 END
         * CASE WHEN days IS NULL THEN 1.0 ELSE greatest(0.5, pow(0.5, days / 365.0) + 0.5) END) AS score FROM aged),
tiered AS (SELECT *, CASE WHEN score >= 0.9 THEN 'HIGH' WHEN score >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM ranked)
"""


def evidence(spark, sf_dir):
    kind, number = F.col("event_type"), F.col("event_id")
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("patient_id"),
        F.when(kind == "click", "rxnorm_rules").when(kind == "view", "kg_traversal").when(kind == "error", "lab_parser").when(kind == "purchase", "vector_search").otherwise("other").alias("source_type"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"),
        F.when(number % 6 > 0, F.date_sub(F.to_date("ts"), (number % 900).cast("int"))).alias("finding_date"), F.col("props").alias("content"),
    )
    return clinical.rank_evidence(raw, F.lit(AS_OF))


@query("num5_rank_evidence", f"WITH {EVIDENCE_SQL} SELECT event_id, round(score, 6) AS confidence, tier FROM tiered")
def num5(spark, sf_dir):
    return evidence(spark, sf_dir).select("event_id", F.round("confidence", 6).alias("confidence"), "tier")


@query("agg13_by_tier", f"""
WITH {EVIDENCE_SQL} SELECT patient_id, count(*) FILTER (WHERE tier = 'HIGH') AS high, count(*) FILTER (WHERE tier = 'MEDIUM') AS medium, count(*) FILTER (WHERE tier = 'LOW') AS low,
  round(coalesce(max(score) FILTER (WHERE tier = 'HIGH'), -1), 6) AS best_high FROM tiered GROUP BY 1
""")
def agg13(spark, sf_dir):
    split = clinical.by_tier(evidence(spark, sf_dir), "patient_id")
    return split.select("patient_id", "high", "medium", "low", F.round(F.coalesce("best_high", F.lit(-1.0)), 6).alias("best_high"))


@query("set2_merge_evidence", f"""
WITH {EVIDENCE_SQL}, parts AS (SELECT patient_id, event_id, props, score, CASE WHEN source_type IN ('kg_traversal', 'rxnorm_rules') THEN 0 ELSE 1 END AS part FROM tiered),
firsts AS (SELECT *, row_number() OVER (PARTITION BY patient_id, props ORDER BY part, event_id) AS r FROM parts)
SELECT patient_id, event_id, round(score, 6) AS confidence FROM firsts WHERE r = 1
""")
def set2(spark, sf_dir):
    ranked = evidence(spark, sf_dir).withColumn("place", F.col("event_id"))
    from_graph = F.col("source_type").isin("kg_traversal", "rxnorm_rules")
    merged = clinical.merge_evidence(ranked.where(from_graph), ranked.where(~from_graph))
    return merged.select("patient_id", "event_id", F.round("confidence", 6).alias("confidence"))


@query("set3_merge_timeline", """
WITH f AS (SELECT CAST(user_id AS VARCHAR) || ':' || event_type || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS finding_id, event_id, event_id % 2 = 0 AS old FROM events),
one AS (SELECT finding_id, old, min(event_id) AS event_id FROM f GROUP BY 1, 2)
SELECT finding_id, event_id FROM one o WHERE old OR NOT EXISTS (SELECT 1 FROM one p WHERE p.old AND p.finding_id = o.finding_id)
""")
def set3(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.to_date("ts").cast("string")).alias("finding_id"), "event_id"
    )
    old, new = (rows.where(F.col("event_id") % 2 == i).groupBy("finding_id").agg(F.min("event_id").alias("event_id")) for i in (0, 1))
    return clinical.merge_timeline(old, new)


NOTES_SQL = f"""
notes AS (
  SELECT event_id, user_id AS patient_id, ts, 'Seen by Dr. Jane Doe on ' || strftime(ts, '%Y-%m-%d') || ', review ' || strftime(ts, '%m/%d/%Y') || ' and ' || CAST(day(ts) AS VARCHAR) || ' ' || strftime(ts, '%B') || ' ' || CAST(year(ts) AS VARCHAR)
    || '. Took ' || event_id % 90 || ' mg and 1.5 mL (E11.9, 2160-0). Bad 2024-02-30. eGFR: ' || event_id % 120 || ' mL/min creatinine: 1.' || event_id % 9 || ' mg/dL' AS note FROM events),
shift AS (SELECT *, CAST(('0x' || substr(sha256(patient_id || 'hipaa-date-shift-salt-v1'), 1, 8))::BIGINT % 181 - 90 AS INTEGER) AS offset_days FROM notes)
"""
MONTH_LIST = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"


def notes(spark, sf_dir):
    """One clinical note per event, with dates in three forms, a name, values and codes."""
    number = F.col("event_id")
    note = F.concat(
        F.lit("Seen by Dr. Jane Doe on "), F.date_format("ts", "yyyy-MM-dd"), F.lit(", review "), F.date_format("ts", "MM/dd/yyyy"), F.lit(" and "),
        F.dayofmonth("ts"), F.lit(" "), F.date_format("ts", "MMMM"), F.lit(" "), F.year("ts"), F.lit(". Took "), number % 90,
        F.lit(" mg and 1.5 mL (E11.9, 2160-0). Bad 2024-02-30. eGFR: "), number % 120, F.lit(" mL/min creatinine: 1."), number % 9, F.lit(" mg/dL"),
    )
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("patient_id"), "ts", note.alias("note"))


@query("dat1_shift_days", f"WITH {NOTES_SQL} SELECT event_id, offset_days, CAST(CAST(ts AS DATE) + offset_days AS VARCHAR) AS shifted FROM shift")
def dat1(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select(
        "event_id", dates.shift_days(F.col("user_id")).alias("offset_days"), dates.shift_date(F.to_date("ts"), F.col("user_id")).cast("string").alias("shifted")
    )


SHIFTED_SQL = f"""
{NOTES_SQL}, moved AS (SELECT *, CAST(ts AS DATE) + offset_days AS d FROM shift),
shifted AS (
  SELECT event_id, patient_id, note, 'Seen by Dr. Jane Doe on ' || strftime(d, '%Y-%m-%d') || ', review ' || strftime(d, '%m/%d/%Y') || ' and ' || CAST(day(d) AS VARCHAR) || ' ' || {MONTH_LIST}[month(d)] || ' ' || CAST(year(d) AS VARCHAR)
    || '. Took ' || event_id % 90 || ' mg and 1.5 mL (E11.9, 2160-0). Bad 2024-02-30. eGFR: ' || event_id % 120 || ' mL/min creatinine: 1.' || event_id % 9 || ' mg/dL' AS text FROM moved)
"""


@query("dat2_shift_text_dates", f"WITH {SHIFTED_SQL} SELECT event_id, text FROM shifted")
def dat2(spark, sf_dir):
    return notes(spark, sf_dir).select("event_id", dates.shift_text_dates(F.col("note"), F.col("patient_id")).alias("text"))


@query("txt16_medical_values", f"""
WITH {NOTES_SQL} SELECT event_id, array_to_string(list_sort(list_distinct([lower(event_id % 90 || ' mg'), '1.5 ml', lower(event_id % 120 || ' mL'), '1.' || event_id % 9 || ' mg', 'E11.9', '2160-0'])), ',') AS found FROM notes
""")
def txt16(spark, sf_dir):
    return notes(spark, sf_dir).select("event_id", F.array_join(text.medical_values(F.col("note")), ",").alias("found"))


@query("txt16_document_values", rf"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(list_transform(regexp_extract_all(text, '(?i){text.MEDICAL_VALUE}'), lambda v: lower(trim(v))), regexp_extract_all(text, '{text.ICD_CODE}')), regexp_extract_all(text, '{text.LOINC_CODE}')))), ',') AS found FROM documents
""")
def txt16_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.medical_values(F.col("text")), ",").alias("found"))


@query("txt17_parse_labs", """
SELECT event_id, 'glucose' AS test_name, CAST(event_id % 300 AS DOUBLE) AS value, 'mg/dL' AS unit FROM events
UNION ALL SELECT event_id, 'total_cholesterol', event_id % 10 + 0.5, '' FROM events
""")
def txt17(spark, sf_dir):
    number = F.col("event_id")
    note = F.concat(F.lit("Glucose: "), number % 300, F.lit(" mg/dL; bad: 1.2.3 x, Total Cholesterol: "), number % 10, F.lit(".5"))
    found = table(spark, sf_dir, "events").select("event_id", F.explode(text.parse_labs(note)).alias("lab"))
    return found.select("event_id", "lab.test_name", "lab.value", "lab.unit")


@query("set4_lost_values", f"""
WITH {NOTES_SQL} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN array_to_string(list_sort(list_distinct(['1.5 ml', 'E11.9'])), ',') ELSE '' END AS lost FROM notes
""")
def set4(spark, sf_dir):
    after = F.when(F.col("event_id") % 3 == 0, F.replace("note", F.lit("1.5 mL (E11.9"), F.lit("(gone"))).otherwise(F.col("note"))
    return notes(spark, sf_dir).select("event_id", F.array_join(clinical.lost_values(F.col("note"), after), ",").alias("lost"))


@query("num6_ecg_imaging", """
WITH e AS (SELECT event_id, 40 + event_id % 80 AS rate, CASE WHEN event_id % 3 > 0 THEN 400 + event_id % 100 END AS qtc, event_id % 7 = 0 AS critical, event_id % 5 = 0 AS noted, event_id % 4 AS part FROM events)
SELECT event_id, critical OR rate < 50 OR rate > 100 OR coalesce(qtc > 450, false) OR noted AS ecg_abnormal,
       CASE WHEN critical THEN 'critical' WHEN rate < 50 OR rate > 100 OR coalesce(qtc > 450, false) OR noted THEN 'high' ELSE 'normal' END AS ecg_severity,
       CASE part WHEN 0 THEN 'neurology' WHEN 1 THEN 'cardiology,pulmonology' WHEN 2 THEN 'pulmonology' ELSE '' END AS imaging_specialists,
       CASE WHEN event_id % 2 = 0 THEN 'moderate' ELSE 'normal' END AS imaging_severity, critical OR noted AS imaging_abnormal FROM e
""")
def num6(spark, sf_dir):
    number = F.col("event_id")
    found = F.array_compact(F.array(F.when(number % 7 == 0, "Complete Heart Block"), F.when(number % 5 == 0, "minor change")))
    rows = table(spark, sf_dir, "events").select(
        "event_id", scores.ecg_finding(40 + number % 80, F.when(number % 3 > 0, 400 + number % 100), found).alias("ecg"),
        scores.imaging_finding(
            F.element_at(F.array(F.lit("Brain"), F.lit("cardiac and chest"), F.lit("LUNG"), F.lit("knee")), (number % 4 + 1).cast("int")),
            found, F.when(number % 2 == 0, "Moderate").otherwise("odd"), F.lit(None).cast("boolean"),
        ).alias("img"),
    )
    return rows.select(
        "event_id", F.col("ecg.abnormal").alias("ecg_abnormal"), F.col("ecg.severity").alias("ecg_severity"),
        F.array_join("img.specialists", ",").alias("imaging_specialists"), F.col("img.severity").alias("imaging_severity"), F.col("img.abnormal").alias("imaging_abnormal"),
    )


TIMELINE_SQL = f"""
{ENTITIES_SQL}, {LABS_SQL}, names AS (SELECT patient_id, string_agg(DISTINCT value, ', ' ORDER BY value) FILTER (WHERE entity_type = 'CONDITION') AS c, string_agg(DISTINCT value, ', ' ORDER BY value) FILTER (WHERE entity_type = 'DRUG') AS d FROM entities GROUP BY 1),
head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY ts, lab_id) AS n FROM results WHERE abnormal) WHERE n <= 10),
abn AS (SELECT patient_id, string_agg(test_name || ':' || CAST(round(value) AS BIGINT) || coalesce(ref_unit, ''), '; ' ORDER BY n) AS l FROM head GROUP BY 1),
timelines AS (
  SELECT p.patient_id, CASE WHEN c IS NULL AND d IS NULL AND l IS NULL THEN 'No structured findings' ELSE concat_ws(' | ', 'Conditions: ' || c, 'Medications: ' || d, 'Abnormal labs: ' || l) END AS summary
  FROM (SELECT DISTINCT patient_id FROM entities UNION SELECT DISTINCT patient_id FROM labs) p LEFT JOIN names USING (patient_id) LEFT JOIN abn USING (patient_id))
"""


@query("txt19_encode_timeline", f"WITH {TIMELINE_SQL} SELECT patient_id, summary FROM timelines")
def txt19(spark, sf_dir):
    rounded = results(spark, sf_dir).withColumn("value", F.round("value").cast("bigint"))
    return clinical.encode_timeline(entities(spark, sf_dir).withColumnRenamed("value", "name"), rounded)


@query("txt20_finding_text", """
SELECT event_id, 'note ' || event_id || ' | DRUG: ' || event_type || ' | eGFR: ' || event_id % 100 || ' mL' || CASE WHEN event_id % 100 < 60 THEN ' [ABNORMAL]' ELSE '' END AS body FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, 'eGFR: ' || event_id % 100 || ' mL' || CASE WHEN event_id % 100 < 60 THEN ' [ABNORMAL]' ELSE '' END FROM events WHERE event_id % 2 = 1
""")
def txt20(spark, sf_dir):
    number, even = F.col("event_id"), F.col("event_id") % 2 == 0
    named = F.when(even, F.array(F.struct(F.lit("DRUG").alias("entity_type"), F.col("event_type").alias("value")))).otherwise(
        F.array().cast("array<struct<entity_type:string,value:string>>"))
    measured = F.array(F.struct(F.lit("eGFR").alias("test_name"), (number % 100).alias("value"), F.lit("mL").alias("unit"), (number % 100 < 60).alias("abnormal")))
    raw = F.when(even, F.concat(F.lit("note "), number)).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", clinical.finding_text(raw, named, measured).alias("body"))


SUMMARY_SQL = f"""
{ACTIVE_SQL}, lines AS (
  SELECT e.patient_id, 0 AS part, CAST(e.date AS VARCHAR) AS a, n.node_id AS b, 'Condition: ' || n.name || ' [' || n.code || '] (diagnosed ' || CAST(e.date AS VARCHAR) || ')' AS line FROM edges e JOIN ent_nodes n USING (node_id) WHERE e.edge = 'DIAGNOSED_WITH'
  UNION ALL SELECT patient_id, 1, printf('%09d', rank), '', 'Drug: ' || name || ' (prescribed ' || CAST(date AS VARCHAR) || ')' FROM active WHERE rank <= 10
  UNION ALL SELECT patient_id, 2, printf('%09d', 1000 - back), '', 'eGFR: ' || CAST(value AS VARCHAR) || ' ' || unit || ' on ' || CAST(date AS VARCHAR) FROM (
    SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY date DESC, node_id DESC) AS back FROM lab_nodes WHERE name = 'eGFR') WHERE back <= 3),
summaries AS (SELECT patient_id, string_agg(line, chr(10) ORDER BY part, a, b, line) AS summary FROM lines GROUP BY 1)
"""


@query("txt20_graph_summary", f"WITH {SUMMARY_SQL} SELECT patient_id, summary FROM summaries")
def txt20_graph(spark, sf_dir):
    return graph.graph_summary(*built(spark, sf_dir))


HITS_SQL = f"""
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), asked AS (SELECT label, min_by(e, vec_id) AS e, min(vec_id) AS q FROM v GROUP BY 1),
vhits AS (SELECT * FROM (SELECT a.label AS patient_id, v.vec_id, round({cosine_sql('a.e', 'v.e')}, 6) AS score, row_number() OVER (PARTITION BY a.label ORDER BY round({cosine_sql('a.e', 'v.e')}, 6) DESC, v.vec_id) AS rank FROM asked a JOIN v ON v.label = a.label) WHERE rank <= 10)
"""


def vector_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("patient_id", F.col("label").cast("bigint"))
    asked = rows.groupBy("patient_id").agg(F.min_by("embedding", "vec_id").alias("embedding")).withColumn("query_id", F.col("patient_id"))
    found = retrieval.search_findings(asked, rows.select("patient_id", F.col("vec_id").alias("finding_id"), "embedding"))
    return found.select(
        "patient_id", F.col("finding_id").cast("string").alias("source_id"), F.concat(F.lit("finding "), "finding_id").alias("content"),
        F.col("score").alias("confidence"), F.col("rank").alias("place"),
    )


def hybrid(spark, sf_dir, newest_drugs=None):
    return graph.hybrid(*built(spark, sf_dir), vector_hits(spark, sf_dir), clinical.rule_table(spark), clinical.alias_table(spark), newest_drugs)


@query("dec15_hybrid_evidence", f"""
WITH {SUMMARY_SQL}, {HITS_SQL}
SELECT patient_id, 'kg_traversal' AS source_type, 'kg:' || patient_id AS source_id, 0.92 AS confidence FROM summaries
UNION ALL SELECT CAST(patient_id AS BIGINT), 'vector_search', CAST(vec_id AS VARCHAR), score FROM vhits
""")
def dec15(spark, sf_dir):
    merged, _ = hybrid(spark, sf_dir)
    return merged.where("source_type <> 'rxnorm_rules'").select("patient_id", "source_type", "source_id", "confidence")


@query("dec15_hybrid_warnings", f"""
WITH {ACTIVE_SQL}, {ALIAS_SQL}, {RULES_SQL}, taken AS (SELECT DISTINCT patient_id, replace(replace(lower(name), '-', '_'), ' ', '_') AS name FROM active),
classes AS (SELECT patient_id, name AS drug_class FROM taken UNION SELECT patient_id, drug_class FROM taken JOIN aliases USING (name)),
newest AS (SELECT patient_id, max_by(value, struct_pack(date, node_id)) AS egfr FROM lab_nodes WHERE name = 'eGFR' GROUP BY 1)
SELECT DISTINCT c.patient_id, r.rule_id FROM classes c JOIN rules r ON r.drug_a = c.drug_class LEFT JOIN newest n ON n.patient_id = c.patient_id
WHERE CASE WHEN metric = '' THEN EXISTS (SELECT 1 FROM classes o WHERE o.patient_id = c.patient_id AND o.drug_class = r.drug_b) ELSE coalesce(n.egfr < threshold, false) END
""")
def dec15_warnings(spark, sf_dir):
    return hybrid(spark, sf_dir)[1].select("patient_id", "rule_id")


@query("dec13_ingest_patients", f"""
WITH {SHIFTED_SQL}
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'lab' WHEN 1 THEN 'ecg' ELSE 'text' END AS modality, replace(text, 'Seen by Dr. Jane Doe on', 'Seen by [PERSON] on') AS clean_text,
       CAST(CAST(s.ts AS DATE) + s.offset_days AS VARCHAR) AS finding_date FROM shifted JOIN shift s USING (event_id)
""")
def dec13(spark, sf_dir):
    docs = notes(spark, sf_dir).select(
        F.col("event_id").alias("source_id"), "patient_id", F.to_date("ts").alias("date"), F.col("note").alias("content"),
        F.when(F.col("event_id") % 4 == 0, "LAB").when(F.col("event_id") % 4 == 1, "ecg").otherwise("").alias("modality"), F.lit(False).alias("has_labs"),
    )
    ingested = patients.ingest_patients(docs, clinical.reference_table(spark))
    return ingested["findings"].select(
        F.col("source_id").alias("event_id"), "modality", "clean_text", F.col("finding_date").cast("string").alias("finding_date")
    )


@query("dec13_ingested_labs", f"""
WITH {NOTES_SQL}
SELECT event_id, 'egfr' AS test_key, CAST(event_id % 120 AS DOUBLE) AS value, NOT (event_id % 120 BETWEEN 60 AND 120) AS abnormal FROM notes WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 'creatinine', 1 + event_id % 9 / 10, NOT (1 + event_id % 9 / 10 BETWEEN 0.6 AND 1.2) FROM notes WHERE event_id % 4 = 0
""")
def dec13_labs(spark, sf_dir):
    number = F.col("event_id")
    note = F.concat(F.lit("lab panel. eGFR: "), number % 120, F.lit(" mL/min creatinine: 1."), number % 9, F.lit(" mg/dL"))
    docs = notes(spark, sf_dir).select(
        number.alias("source_id"), "patient_id", F.to_date("ts").alias("date"), note.alias("content"),
        F.when(number % 4 == 0, "lab").otherwise("text").alias("modality"), F.lit(False).alias("has_labs"),
    )
    made = patients.ingest_patients(docs, clinical.reference_table(spark))["labs"]
    return made.select(F.col("source_id").alias("event_id"), "test_key", "value", "abnormal")
