"""Dated patient graph as node and edge tables, and the reads over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.config import CLINICAL
from tracemill.functions.keys import graph_node_id
from tracemill.operators.clinical import LAB_ORDER, interactions, lab_edges, latest_labs, merge_evidence
from tracemill.operators.skew import top_per

EDGE_TYPES = {"condition": "DIAGNOSED_WITH", "drug": "PRESCRIBED", "symptom": "HAS_SYMPTOM"}


def build_graph(entities: DataFrame, labs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) merged by id.

    ``entities``: (patient_id, finding_date, entity_type, value, code) with the
    code an ICD or RxNorm id or null; ``labs``: (patient_id, test_name, value,
    unit, ts, lab_id). A condition or symptom keeps its first name, a drug and
    a lab value take the last write. Every merge is one aggregation that
    reduces a hot node before the shuffle.
    """
    kind = F.lower("entity_type")
    own = graph_node_id(F.col("patient_id"), kind, F.col("value"))
    named = entities.where(kind.isin(*EDGE_TYPES)).select(
        "patient_id", kind.alias("kind"), F.col("value").alias("name"), F.col("finding_date").alias("date"), "code",
        F.when(kind == "drug", F.coalesce("code", own)).otherwise(own).alias("node_id"),
    )
    order = F.struct("date", "name")
    entity_nodes = named.groupBy("node_id", "kind").agg(
        F.min_by(F.struct("name", "code"), order).alias("_first"), F.max_by(F.struct("name", "code"), order).alias("_last")
    )
    picked = F.when(F.col("kind") == "drug", F.col("_last")).otherwise(F.col("_first"))
    no_text, no_number, no_date = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("date")
    entity_rows = entity_nodes.withColumn("_p", picked).select(
        "node_id", "kind", F.col("_p.name").alias("name"), F.coalesce("_p.code", F.lit("")).alias("code"),
        no_number.alias("value"), no_text.alias("unit"), no_date.alias("date"),
    )
    day = F.to_date("ts")
    lab_id = graph_node_id(F.col("patient_id"), F.lit("lab"), F.concat("test_name", F.lit(":"), day.cast("string")))
    dated = labs.select("patient_id", "test_name", "value", "unit", *LAB_ORDER, day.alias("date"), lab_id.alias("node_id"))
    lab_rows = dated.groupBy("node_id").agg(
        F.max_by(F.struct("test_name", "value", "unit", "date"), F.struct(*LAB_ORDER)).alias("_l")
    ).select(
        "node_id", F.lit("lab").alias("kind"), F.col("_l.test_name").alias("name"), F.lit("").alias("code"),
        F.col("_l.value").alias("value"), F.col("_l.unit").alias("unit"), F.col("_l.date").alias("date"),
    )
    everyone = entities.select("patient_id").unionByName(labs.select("patient_id")).distinct()
    patient_rows = everyone.select(
        F.col("patient_id").cast("string").alias("node_id"), F.lit("patient").alias("kind"), F.col("patient_id").cast("string").alias("name"),
        F.lit("").alias("code"), no_number.alias("value"), no_text.alias("unit"), no_date.alias("date"),
    )
    types = F.create_map(*[F.lit(v) for pair in EDGE_TYPES.items() for v in pair])
    edges = named.select("patient_id", "node_id", types[F.col("kind")].alias("edge"), "date").unionByName(
        dated.select("patient_id", "node_id", F.lit("HAS_LAB").alias("edge"), "date")
    ).distinct()
    return patient_rows.unionByName(entity_rows).unionByName(lab_rows), edges


def lab_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lab values of the graph with their patient, shaped like a labs table."""
    held = edges.where(F.col("edge") == "HAS_LAB").select("patient_id", "node_id")
    return held.join(nodes.where(F.col("kind") == "lab"), "node_id").select(
        "patient_id", F.col("name").alias("test_name"), "value", "unit", F.col("date").cast("timestamp").alias("ts"),
        F.col("node_id").alias("lab_id"),
    )


def preceded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """PRECEDED edges between neighbouring values of one test."""
    return lab_edges(lab_nodes(nodes, edges))


def _linked(nodes: DataFrame, edges: DataFrame, edge: str) -> DataFrame:
    ends = nodes.select("node_id", "name", "code")
    return edges.where(F.col("edge") == edge).select("patient_id", "node_id", "date").join(ends, "node_id")


def active_drugs(nodes: DataFrame, edges: DataFrame, k: int = CLINICAL.active_drugs) -> DataFrame:
    """Newest prescriptions per patient."""
    order = [F.col("date").desc(), F.col("name"), F.col("node_id")]
    return top_per(_linked(nodes, edges, "PRESCRIBED"), ["patient_id"], order, k)


def conditions_timeline(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Diagnoses per patient, oldest first."""
    return _linked(nodes, edges, "DIAGNOSED_WITH").orderBy("patient_id", "date", "node_id")


def temporal_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Drugs, labs and conditions of each patient as one event table (no product of the three)."""
    drugs = _linked(nodes, edges, "PRESCRIBED").select("patient_id", F.lit("drug").alias("type"), "name", "date")
    conditions = _linked(nodes, edges, "DIAGNOSED_WITH").select(
        "patient_id", F.lit("condition").alias("type"), "name", "date", F.col("code").alias("icd")
    )
    labs = lab_nodes(nodes, edges).select(
        "patient_id", F.lit("lab").alias("type"), F.col("test_name").alias("name"), F.to_date("ts").alias("date"), "value", "unit"
    )
    return drugs.unionByName(labs, allowMissingColumns=True).unionByName(conditions, allowMissingColumns=True).distinct()


def drug_lab_phase(nodes: DataFrame, edges: DataFrame, drug: str, test: str) -> DataFrame:
    """Each value of a test with how many prescription days of a drug it came before, and on or after.

    A patient's prescription days are distinct dates, so they fit in one value;
    counting them against each lab needs no pair of rows.
    """
    days = _linked(nodes, edges, "PRESCRIBED").where(F.lower("name") == drug.lower()).groupBy("patient_id").agg(
        F.collect_set("date").alias("_days")
    )
    values = lab_nodes(nodes, edges).where(F.lower("test_name") == test.lower())
    before = F.size(F.filter("_days", lambda d: F.col("date") < d))
    return (
        values.withColumn("date", F.to_date("ts")).join(days, "patient_id")
        .withColumn("before", before).withColumn("after", F.size("_days") - F.col("before"))
        .select("patient_id", "lab_id", "value", "unit", "date", "before", "after")
    )


def graph_summary(nodes: DataFrame, edges: DataFrame, drugs: int = 10, egfr: int = 3) -> DataFrame:
    """Summary text per patient: conditions, newest drugs, last eGFR values."""
    def lines(df: DataFrame, part: int, order: list[Column], line: Column) -> DataFrame:
        return df.select("patient_id", F.struct(F.lit(part).alias("part"), *order, line.alias("line")).alias("_line"))

    known = _linked(nodes, edges, "DIAGNOSED_WITH")
    taken = active_drugs(nodes, edges, drugs)
    measured = top_per(
        lab_nodes(nodes, edges).where(F.lower("test_name") == "egfr"), ["patient_id"], [F.col(c).desc() for c in LAB_ORDER], egfr, "_back"
    )
    day = F.col("date").cast("string")
    every = lines(known, 0, [F.col("date").cast("string").alias("a"), F.col("node_id").alias("b")], F.concat(
        F.lit("Condition: "), "name", F.lit(" ["), "code", F.lit("] (diagnosed "), day, F.lit(")")))
    every = every.unionByName(lines(taken, 1, [F.format_string("%09d", "rank").alias("a"), F.lit("").alias("b")], F.concat(
        F.lit("Drug: "), "name", F.lit(" (prescribed "), day, F.lit(")"))))
    every = every.unionByName(lines(measured, 2, [F.format_string("%09d", -F.col("_back") + 1000).alias("a"), F.lit("").alias("b")], F.concat(
        F.lit("eGFR: "), F.col("value").cast("string"), F.lit(" "), "unit", F.lit(" on "), F.to_date("ts").cast("string"))))
    # A summary is one text: the diagnoses of one patient and a few drugs and values.
    return every.groupBy("patient_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("_line")), lambda s: s["line"]), "\n").alias("summary")
    )


def hybrid(nodes: DataFrame, edges: DataFrame, hits: DataFrame, rules: DataFrame, aliases: DataFrame,
           newest_drugs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(evidence, warnings) per patient: graph summary, rule warnings and vector hits, merged.

    ``hits``: (patient_id, source_id, content, confidence, place). The rules
    get every drug of a patient, or only those of the ``newest_drugs`` prescriptions.
    """
    summary = graph_summary(nodes, edges).select(
        "patient_id", F.lit("kg_traversal").alias("source_type"), F.concat(F.lit("kg:"), F.col("patient_id").cast("string")).alias("source_id"),
        F.col("summary").alias("content"), F.lit(0.92).alias("confidence"), F.lit(0).alias("place"),
    )
    taken = active_drugs(nodes, edges, newest_drugs) if newest_drugs else _linked(nodes, edges, "PRESCRIBED")
    drugs = taken.select("patient_id", F.col("name").alias("drug")).distinct()
    newest = latest_labs(lab_nodes(nodes, edges)).where(F.lower("test_name").isin("egfr", "creatinine"))
    warnings = interactions(drugs, newest, rules, aliases)
    line = F.concat(
        F.lit("DRUG INTERACTION ["), F.upper("severity"), F.lit("]: "), "drug_a", F.lit(" + "), "drug_b", F.lit(". "),
        "recommendation", F.lit(" ["), "source", F.lit("]"),
    )
    # At most one line per rule of the fixed rule table.
    warned = warnings.groupBy("patient_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rule_id", line.alias("line")))), lambda s: s["line"]), "\n").alias("content")
    ).select(
        "patient_id", F.lit("rxnorm_rules").alias("source_type"), F.lit("rxnorm").alias("source_id"), "content",
        F.lit(0.98).alias("confidence"), F.lit(1).alias("place"),
    )
    found = hits.select("patient_id", F.lit("vector_search").alias("source_type"), "source_id", "content", "confidence", "place")
    return merge_evidence(summary.unionByName(warned), found), warnings
