"""Patient ingest: route, de-identify, findings, labs, timeline text, graph tables, audit entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import dates, text
from tracemill.operators import clinical, graph


def ingest_patients(docs: DataFrame, reference: DataFrame, entities: DataFrame | None = None) -> dict[str, DataFrame]:
    """One table per stage.

    ``docs``: (source_id, patient_id, date, content, modality, has_labs).
    ``entities``: (patient_id, finding_date, entity_type, value, code) as an
    extraction model supplied them; without it the graph holds labs only.
    Both the dates in the text and the finding date are shifted.
    """
    routed = docs.withColumn("modality", text.modality(F.col("modality"), F.col("content"), F.col("has_labs")))
    findings = (
        clinical.deidentify(routed, "content", "patient_id")
        .withColumn("finding_date", dates.shift_date(F.col("date"), F.col("patient_id")))
        .select("source_id", "patient_id", "modality", "finding_date", "clean_text", "lost", "integrity_ok", "length_drift")
    )
    parsed = findings.where("modality = 'lab'").select(
        "source_id", "patient_id", "finding_date", F.posexplode(text.parse_labs(F.col("clean_text"))).alias("place", "lab")
    ).select(
        "source_id", "patient_id", F.col("finding_date").cast("timestamp").alias("ts"), "lab.test_name", "lab.value", "lab.unit",
        F.concat_ws(":", F.col("source_id").cast("string"), F.format_string("%06d", "place")).alias("lab_id"),
        F.lit(None).cast("double").alias("previous_value"),
    )
    labs = clinical.lab_results(parsed, reference)
    known = entities if entities is not None else docs.sparkSession.createDataFrame(
        [], f"patient_id {docs.schema['patient_id'].dataType.simpleString()}, finding_date date, entity_type string, value string, code string"
    )
    nodes, edges = graph.build_graph(known, labs)
    audit = findings.groupBy("patient_id").agg(F.count(F.lit(1)).alias("finding_count")).select(
        "patient_id", F.lit("ingest").alias("event_type"), F.lit("system").alias("requester_id"),
        F.concat(F.lit('{"finding_count": '), "finding_count", F.lit("}")).alias("payload_json"),
    )
    return {
        "findings": findings, "labs": labs, "nodes": nodes, "edges": edges, "audit": audit,
        "timelines": clinical.encode_timeline(known.withColumnRenamed("value", "name"), labs),
    }
