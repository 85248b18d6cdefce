"""Queries of the audit chain (events: one chain per user in step order)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import audit
from tracemill.operators.skew import stage
from tracemill.registry import query
from tracemill.registry.tables import STEPS_SQL, steps

CHAIN_SQL = f"""
{STEPS_SQL}, entries AS (
  SELECT session_id AS patient_id, step AS sequence, 'e' || event_id AS entry_id, tool_name AS event_type, tool_args AS payload_json,
         sha256('{{"entry_id": "e' || event_id || '", "event_type": "' || tool_name || '", "patient_id": "' || session_id || '", "payload": ' || tool_args || ', "requester_id": "system", "sequence": ' || step || '}}') AS content_hash FROM steps),
chained(patient_id, sequence, entry_id, event_type, payload_json, content_hash, prev_hash, chain_hash) AS (
  SELECT patient_id, sequence, entry_id, event_type, payload_json, content_hash, repeat('0', 64), sha256(content_hash || repeat('0', 64)) FROM entries WHERE sequence = 1
  UNION ALL SELECT e.patient_id, e.sequence, e.entry_id, e.event_type, e.payload_json, e.content_hash, c.chain_hash, sha256(e.content_hash || c.chain_hash)
  FROM chained c JOIN entries e ON e.patient_id = c.patient_id AND e.sequence = c.sequence + 1)
"""


def entries(spark, sf_dir):
    return steps(spark, sf_dir).select(
        F.col("session_id").alias("patient_id"), F.col("step").alias("sequence"), F.concat(F.lit("e"), "event_id").alias("entry_id"),
        F.col("tool_name").alias("event_type"), F.lit("system").alias("requester_id"), F.col("tool_args").alias("payload_json"),
    )


@query("dec16_audit_chain", f"WITH RECURSIVE {CHAIN_SQL} SELECT patient_id, sequence, content_hash, prev_hash, chain_hash FROM chained")
def dec16(spark, sf_dir):
    return audit.chain(entries(spark, sf_dir)).select("patient_id", "sequence", "content_hash", "prev_hash", "chain_hash")


@query("dec16_chain_heads", f"""
WITH RECURSIVE {CHAIN_SQL} SELECT patient_id, max(sequence) AS sequence, max_by(chain_hash, sequence) AS head, sha256(max_by(chain_hash, sequence) || repeat('0', 64)) AS heads_hash FROM chained GROUP BY 1
""")
def dec16_heads(spark, sf_dir):
    return audit.chain_heads(audit.chain(entries(spark, sf_dir))).select("patient_id", "sequence", "head", "heads_hash")


@query("win10_verify_chain", f"""
WITH RECURSIVE {CHAIN_SQL}, longest AS (SELECT patient_id, max(sequence) AS n FROM chained GROUP BY 1)
SELECT c.patient_id, c.sequence, unnest(CASE c.patient_id % 10 WHEN 0 THEN ['content hash mismatch', 'chain hash broken'] WHEN 1 THEN ['chain hash broken'] ELSE ['chain hash broken', 'prev hash mismatch'] END) AS kind
FROM chained c WHERE (c.patient_id % 10 = 0 AND c.sequence = 5) OR (c.patient_id % 10 = 1 AND c.sequence = 4) OR (c.patient_id % 10 = 2 AND c.sequence = 4)
UNION ALL SELECT c.patient_id, c.sequence, unnest(['chain hash broken', 'prev hash mismatch']) FROM chained c WHERE c.patient_id % 10 = 1 AND c.sequence = 5
""")
def win10(spark, sf_dir):
    patient, place = F.col("patient_id") % 10, F.col("sequence")
    # Planted faults: a changed payload, a changed chain hash, a missing entry.
    tampered = (
        audit.chain(entries(spark, sf_dir)).where(~((patient == 2) & (place == 3)))
        .withColumn("payload_json", F.when((patient == 0) & (place == 5), '{"k": -1}').otherwise(F.col("payload_json")))
        .withColumn("chain_hash", F.when((patient == 1) & (place == 4), F.sha2("chain_hash", 256)).otherwise(F.col("chain_hash")))
    )
    return audit.verify_chain(tampered)


@query("win10_global_tree", f"""
WITH RECURSIVE {CHAIN_SQL}, heads AS (SELECT patient_id, max(sequence) AS sequence, max_by(chain_hash, sequence) AS head FROM chained GROUP BY 1),
leaves AS (SELECT sha256(patient_id::VARCHAR) AS key, sha256(patient_id || '|' || sequence || '|' || head) AS leaf FROM heads),
l2 AS (SELECT substr(key, 1, 2) AS node, sha256(string_agg(key || leaf, '' ORDER BY key)) AS hash FROM leaves GROUP BY 1),
l1 AS (SELECT substr(node, 1, 1) AS node, sha256(string_agg(node || hash, '' ORDER BY node)) AS hash FROM l2 GROUP BY 1)
SELECT 2 AS level, node, hash FROM l2 UNION ALL SELECT 1, node, hash FROM l1 UNION ALL SELECT 0, '', sha256(string_agg(node || hash, '' ORDER BY node)) FROM l1
""")
def win10_tree(spark, sf_dir):
    return audit.merkle_tree(audit.chain_heads(audit.chain(entries(spark, sf_dir))), depth=2)


@query("win10_changed_patients", f"""
WITH {STEPS_SQL}
SELECT DISTINCT session_id AS patient_id, CASE session_id % 10 WHEN 3 THEN 'missing' WHEN 4 THEN 'changed' ELSE 'new' END AS kind
FROM steps WHERE session_id % 10 IN (3, 5) OR (session_id % 10 = 4 AND step = 2)
""")
def win10_changed(spark, sf_dir):
    whole = stage(audit.chain_heads(audit.chain(entries(spark, sf_dir))))
    patient = F.col("patient_id") % 10
    # Planted: patients that came later, that were deleted whole, and whose second entry was forged with its chain rebuilt.
    stored = whole.where(patient != 5)
    forged = entries(spark, sf_dir).where((patient == 4)).withColumn("payload_json", F.when(F.col("sequence") == 2, F.lit("{}")).otherwise(F.col("payload_json")))
    now = whole.where(~patient.isin(3, 4)).unionByName(audit.chain_heads(audit.chain(forged)))
    return audit.changed_patients(audit.merkle_tree(stored, 2), stored, audit.merkle_tree(now, 2), now, 2)


@query("top7_audit_entries", f"""
WITH RECURSIVE {CHAIN_SQL} SELECT patient_id, sequence, substr(chain_hash, 1, 16) || '...' AS chain_hash FROM chained ORDER BY sequence DESC, entry_id LIMIT 100
""")
def top7_audit(spark, sf_dir):
    return audit.list_entries(audit.chain(entries(spark, sf_dir))).select("patient_id", "sequence", "chain_hash")
