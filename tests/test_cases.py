"""Literal cases of single operators: ids, chunks, dates, labs, drugs, refunds, evaluation, audit, nested arguments."""

import datetime as dt
import hashlib
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tracemill.config import EVALUATION
from tracemill.functions import dates, keys, scores, text
from tracemill.operators import audit, clinical, documents, evaluation, graph, refunds, relational
from tracemill.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_document_ids(spark):
    made = text.document_id(*[F.lit(v) for v in ("in", "m-h", "Mum bai long name", 2019, "case_law", "48#21", 1)])
    assert one(spark, made) == "IN:MH:MUMBAILO:2019:CR:4821:v1"
    assert one(spark, text.chunk_id(F.lit("A:v1"), F.lit(42))) == "A:v1:0042"
    assert one(spark, text.chunk_id(F.lit("A:v1"), F.lit(123456))) == "A:v1:123456"
    assert one(spark, text.base_id(F.lit("IN:MH:v2"))) == "IN:MH" and one(spark, text.base_id(F.lit("plain"))) == "plain"
    assert one(spark, text.bump_version(F.lit("A:v9"))) == "A:v10" and one(spark, text.bump_version(F.lit("A"))) == "A:v2"


def test_chunks_carry_overlap_and_labels(spark):
    words = " ".join(f"w{i}" for i in range(200))
    body = f"# One\n\n{words}\n\n\n{words}\n\nTWO PART: x\n\n{words}"
    df = spark.createDataFrame([("D:v1", body)], "id string, body string")
    got = documents.chunks(df, "id", "body").orderBy("chunk_index").collect()
    assert [c.chunk_id for c in got] == [f"D:v1:{i:04d}" for i in range(len(got))] and len(got) == 3
    assert got[0].text.startswith("# One") and got[1].text.split()[:30] == got[0].text.split()[-30:]
    assert documents.chunks(df.withColumn("body", F.lit("  \n\n ")), "id", "body").count() == 0


def test_a_closing_heading_labels_the_chunk_unless_asked_otherwise(spark):
    body = "# One\n\n" + "a" * 1400 + "\n\n# Two " + "b" * 200
    df = spark.createDataFrame([("D", body)], "id string, body string")
    first = [documents.chunks(df, "id", "body", label_before_flush=f).orderBy("chunk_index").first().section for f in (True, False)]
    assert first[0].startswith("# Two") and first[1] == "# One"


def python_offset(patient):
    digest = hashlib.sha256((patient + "hipaa-date-shift-salt-v1").encode()).digest()
    return int.from_bytes(digest[:4], "big") % 181 - 90


def test_dates_in_text_move_together(spark):
    days = dt.timedelta(python_offset("p1"))
    moved = lambda y, m, d: dt.date(y, m, d) + days
    source = "On 2024-01-15, 02/28/2024 and 5 March 2024; not 2024-02-30 or 13/45/2024."
    a, b, c = moved(2024, 1, 15), moved(2024, 2, 28), moved(2024, 3, 5)
    want = f"On {a.isoformat()}, {b:%m/%d/%Y} and {c.day} {c:%b} {c.year}; not 2024-02-30 or 13/45/2024."
    assert one(spark, dates.shift_text_dates(F.lit(source), F.lit("p1"))) == want


LABS = [("eGFR", 60.0, False, "normal"), ("eGFR", 59.9, True, "low"), ("eGFR", 53.9, True, "moderate"), ("eGFR", 41.9, True, "high"),
        ("egfr", 29.9, True, "critical"), ("Total Cholesterol", 200.0, False, "normal"), ("mystery", 1e9, False, "normal")]


def test_lab_severity(spark):
    rows = [(i, "p", n, v, "", None) for i, (n, v, _, _) in enumerate(LABS)]
    df = spark.createDataFrame(rows, "lab_id int, patient_id string, test_name string, value double, unit string, previous_value double")
    got = {r.lab_id: (r.abnormal, r.severity) for r in clinical.lab_results(df, clinical.reference_table(spark)).collect()}
    assert got == {i: (a, s) for i, (_, _, a, s) in enumerate(LABS)}


@pytest.mark.parametrize("drugs, egfr, want", [
    (["Metformin", "iodinated-contrast"], None, {"contrast_dye"}),
    (["metformin"], 29.9, {"egfr < 30.0"}), (["metformin"], 30.0, set()), (["metformin"], None, set()),
    (["lisinopril", "spironolactone", "ibuprofen"], None, {"potassium_sparing_diuretic", "ace_inhibitor"}),
    (["warfarin"], None, set()),
])
def test_drug_rules(spark, drugs, egfr, want):
    taken = spark.createDataFrame([("p", d) for d in drugs], "patient_id string, drug string")
    labs = spark.createDataFrame([("p", "eGFR", egfr)] if egfr else [], "patient_id string, test_name string, value double")
    got = clinical.interactions(taken, labs, clinical.rule_table(spark), clinical.alias_table(spark))
    assert {r.drug_b for r in got.collect()} == want


def test_deidentified_note(spark):
    df = spark.createDataFrame([("p", "Dr. Jane Roe saw Ann Lee: 5 mg, E11.9")], "patient string, body string")
    row = clinical.deidentify(df, "body", "patient").first()
    assert row.clean_text == "[PERSON] saw [PERSON]: 5 mg, E11.9" and row.integrity_ok and row.lost == []


def test_refund_rules_in_order(spark):
    rows = [(1, 7, False, True, "2024-01-01"), (2, 8, True, False, "2020-01-01"), (3, 8, False, False, "2020-01-01"), (4, 8, False, True, "2023-12-31"), (5, 8, False, True, "2024-01-01")]
    df = spark.createDataFrame(rows, "id int, user_id int, refunded boolean, refund_eligible boolean, day string").withColumn("created_at", F.to_timestamp("day"))
    got = {r.id: r.v for r in df.select("id", refunds.rejection(F.lit("2024-01-31").cast("timestamp"), F.lit(8)).alias("v")).collect()}
    assert got == {1: "not owned by this account", 2: "already refunded", 3: "product type not eligible for refund",
                   4: "outside 30-day refund window", 5: None}


def test_velocity_counts_only_admitted_requests(spark):
    seconds = [0, 1, 2, 3, 4, 5, 6, 86_400, 86_401]
    df = spark.createDataFrame([("u", i, s) for i, s in enumerate(seconds)], "user_id string, event_id int, s long").withColumn("ts", F.timestamp_seconds("s"))
    for block in (2, 4096):
        got = [r.admitted for r in refunds.velocity_gate(df, block_rows=block).orderBy("event_id").collect()]
        # The request exactly one day old is outside the window.
        assert got == [True] * 5 + [False, False] + [True, True]


def test_attempts_leave_out_the_second_one_day_ago(spark):
    df = spark.createDataFrame([("u", 0), ("u", 1), ("u", 1), ("u", 86_400)], "user_id string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.second: r.attempts for r in refunds.attempts(df).collect()} == {0: 0, 1: 2, 86_400: 2}


def test_triage_order(spark):
    rows = [(1, False, 1, True, 1, 0.9, False, "10"), (2, True, 1, False, 0, None, False, "0"), (3, True, 1, True, 0, 0.9, False, "0"), (4, True, 1, True, 1, None, False, "10"),
            (5, True, 1, True, 1, 0.84, False, "10"), (6, True, 1, True, 1, 0.9, True, "10"), (7, True, 1, True, 1, 0.9, False, "500.01"), (8, True, 1, True, 1, 0.85, False, "500.00")]
    df = spark.createDataFrame([(*r[:7], Decimal(r[7])) for r in rows], "id int, confirmed boolean, candidates int, velocity_ok boolean, eligible int, confidence_score double, requires_human boolean, total_amount decimal(12,2)")
    got = {r.id: (r.outcome, r.escalation_reason) for r in refunds.triage(df).collect()}
    assert got == {1: ("pending_confirmation", None), 2: ("escalated", "velocity_exceeded"), 3: ("ineligible", None), 4: ("pending_evidence", None),
                   5: ("escalated", "low_confidence"), 6: ("escalated", "low_confidence"), 7: ("escalated", "high_amount"), 8: ("executing", None)}


def test_selection_errors_on_text(spark):
    df = spark.createDataFrame([(1, 1, "x")], "session_id int, transaction_id int, selection string").withColumn("created_at", F.current_timestamp())
    with pytest.raises(Exception):
        refunds.select_by_index(df, "session_id", "selection").collect()


CARD = dict(code_gen_old=0.9, code_gen_new=0.9, bug_fix_old=0.8, bug_fix_new=0.8, explanation_old=0.7, explanation_new=0.7, weighted_regression=0.0, regressions=0)


@pytest.mark.parametrize("change, want", [
    ({}, "ship"), ({"code_gen_new": 0.8}, "hold"), ({"bug_fix_new": 0.65}, "hold"), ({"explanation_new": 0.3}, "hold"),
    ({"weighted_regression": 5.1, "regressions": 9}, "hold"), ({"weighted_regression": 5.0, "regressions": 9}, "review"),
])
def test_ship_decision(spark, change, want):
    row = CARD | change
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'long' if k == 'regressions' else 'double'}" for k in row))
    assert evaluation.ship(df).first().decision == want


def test_quality_weight_and_flags(spark):
    rows = [(True, False, 0.05, None, 1.0), (True, False, 0.5, True, 0.9), (False, False, 1.0, None, 0.3), (True, True, 0.5, None, 0.3), (True, False, 0.5, False, 0.6), (False, False, 1.0, False, 0.6)]
    df = spark.createDataFrame(rows, "c boolean, r boolean, e double, t boolean, want double")
    got = df.select("want", scores.quality_weight(F.col("c"), F.col("r"), F.col("e"), F.col("t")).alias("v")).collect()
    assert all(r.want == r.v for r in got)
    regressed, improved = scores.change_flags(F.col("a"), F.col("b"), F.lit(None).cast("double"), F.lit(0.9), EVALUATION)
    pairs = spark.createDataFrame([(0.9, 0.8), (0.5, 0.5), (0.5, 0.6), (0.5, None)], "a double, b double")
    assert [tuple(r) for r in pairs.select(regressed, improved).collect()] == [(True, False), (False, False), (False, True), (False, False)]


def test_audit_chain_and_planted_faults(spark):
    rows = [("p", i, f"e{i}", "query", "system", '{"k": %d}' % i) for i in range(1, 12)]
    log = spark.createDataFrame(rows, "patient_id string, sequence long, entry_id string, event_type string, requester_id string, payload_json string")
    plain = audit.chain(log).orderBy("sequence").collect()
    body = json.dumps({"entry_id": "e1", "sequence": 1, "event_type": "query", "patient_id": "p", "requester_id": "system", "payload": {"k": 1}}, sort_keys=True)
    content = hashlib.sha256(body.encode()).hexdigest()
    assert plain[0].content_hash == content and plain[0].chain_hash == hashlib.sha256((content + "0" * 64).encode()).hexdigest()
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows_per_batch in ("2", "3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_per_batch)
            assert audit.chain(log).orderBy("sequence").collect() == plain
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    chained, heads = audit.chain(log), audit.chain_heads(audit.chain(log))
    assert audit.verify_chain(chained, heads).count() == 0
    changed = chained.withColumn("payload_json", F.when(F.col("sequence") == 6, '{"k": 0}').otherwise(F.col("payload_json")))
    assert {(r.sequence, r.kind) for r in audit.verify_chain(changed, heads).collect()} == {(6, "content hash mismatch"), (6, "chain hash broken")}
    for gone in ({1}, {3}, {7}, {11}, {2, 3, 4}, {1, 2}, {9, 10, 11}, set(range(1, 12))):
        found = audit.verify_chain(chained.where(~F.col("sequence").isin(*gone)), heads).collect()
        after = max(gone) + 1
        assert {(r.sequence, r.kind) for r in found} == ({(11, "tail missing")} if after > 11 else {(after, "chain hash broken"), (after, "prev hash mismatch")})
    first = audit.chain(log.where("sequence <= 5"))
    more = audit.chain(log.where("sequence > 5"), audit.chain_heads(first))
    assert first.unionAll(more).orderBy("sequence").collect() == plain


def reference_form(value):
    if isinstance(value, dict):
        return {k: reference_form(value[k]) for k in value}
    if isinstance(value, list):
        return sorted(map(reference_form, value), key=str) if not any(isinstance(v, (dict, list)) or v is None for v in value) else list(map(reference_form, value))
    return value.strip() if isinstance(value, str) else round(value, 4) if isinstance(value, float) else value


def test_nested_call_fingerprints(spark):
    args = [{"b": 1, "a": " x "}, {"a": "x", "b": 1}, {"n": {"z": [3, 1, 2], "y": 0.123456}}, {"n": {"y": 0.12346, "z": [2, 3, 1]}}, {"l": [{"b": 1}, {"a": 2}]}]
    df = spark.createDataFrame([(i, "t", json.dumps(a)) for i, a in enumerate(args)], "i int, tool string, args string")
    got = [r.v for r in df.select("i", keys.call_fingerprint(F.col("tool"), F.col("args")).alias("v")).orderBy("i").collect()]
    assert got[0] == got[1] and got[0] != got[2]
    want = [hashlib.sha256(("t:" + json.dumps(reference_form(a), sort_keys=True)).encode()).hexdigest() for a in args]
    assert got == want
    flat = spark.createDataFrame([("t", '{"b": 1, "a": " x "}')], "tool string, args string")
    assert flat.select(keys.call_fingerprint(F.col("tool"), F.col("args")).alias("v")).first().v == got[0]


def test_fingerprint_six_levels_down(spark):
    deep = lambda inner: f'{{"a": [{{"b": [{{"c": {inner}}}, 7]}}]}}'
    rows = [(deep('{"y": " x ", "x": 2.000049}'), deep('{"x":2.00001,"y":"x"}'), True), (deep('{"x": 1}'), deep('{"x": 2}'), False)]
    df = spark.createDataFrame(rows, "a string, b string, same boolean")
    got = df.select("a", "same", keys.call_fingerprint(F.lit("t"), F.col("a")).alias("x"), keys.call_fingerprint(F.lit("t"), F.col("b")).alias("y")).collect()
    assert all(r.same == (r.x == r.y) for r in got)
    assert got[0].x == hashlib.sha256(("t:" + json.dumps(reference_form(json.loads(got[0].a)), sort_keys=True)).encode()).hexdigest()


def test_correction_without_a_tool_name(spark):
    from tracemill.operators import agents

    rows = [(None, 1, 0, ["exact_duplicate"], True), ("x", 1, 0, ["exact_duplicate"], True)]
    df = spark.createDataFrame(rows, "tool_name string, step int, first_step int, signals array<string>, flagged boolean")
    got = {r.tool_name: r.message for r in agents.correction(df).collect()}
    assert "called your last tool call with" in got[None] and "called 'x' with" in got["x"]


def test_fingerprint_tells_values_apart(spark):
    pairs = [("1.50001", "1.500012", True), ("[2,1]", "[1,2]", True), ("true", '"true"', False), ("12", '"12"', False), ('" é "', '"é"', True), ('{"b":1,"a":[{}]}', '{"a":[{}],"b":1}', True), ("[[2],[1]]", "[[1],[2]]", False)]
    rows = [(f'{{"k":{a}}}', f'{{"k":{b}}}', same) for a, b, same in pairs] + [(None, "{}", True), ("{broken", "{}", False)]
    df = spark.createDataFrame(rows, "a string, b string, same boolean")
    name = F.lit("t")
    got = df.select("a", "same", (keys.call_fingerprint(name, F.col("a")) == keys.call_fingerprint(name, F.col("b"))).alias("equal"))
    assert all(r.same == r.equal for r in got.collect())
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_feed_file(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        "<rss><channel>"
        "<item><link>http://a/1</link><title>One</title><description>&lt;p&gt;Body one&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><category>x</category></item>"
        "<item><title>no link</title><description>b</description></item>"
        "<item><link>http://a/2</link><title>empty</title></item>"
        "<item><link>http://a/1</link><title>again</title><description>other</description></item>"
        "<item><link>http://a/3</link><title>undated</title><description>c</description></item>"
        "</channel></rss>"
    )
    items = readers.read_feed_files(spark, str(tmp_path))
    now = F.lit("2024-02-01").cast("timestamp")
    got = {r.url: (r.title, r.body, str(r.published_at)) for r in readers.feed_articles(items, F.lit("s"), now).collect()}
    assert got == {"http://a/1": ("One", "Body one", "2024-01-02 10:00:00"), "http://a/3": ("undated", "c", "2024-02-01 00:00:00")}
    seen = spark.createDataFrame([("http://a/1",)], "url string")
    assert {r.url for r in readers.feed_articles(items, F.lit("s"), now, seen).collect()} == {"http://a/3"}


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a", 1)], "k int, v string, o int")
    new = spark.createDataFrame([(1, "b", 1), (2, "c", 5), (2, "d", 4)], "k int, v string, o int")
    assert {(r.k, r.v) for r in relational.upsert(old, new, ["k"], [F.col("o")]).collect()} == {(1, "b"), (2, "c")}
    assert {(r.k, r.v) for r in relational.insert_absent(old, new, ["k"], [F.col("o")]).collect()} == {(1, "a"), (2, "d")}


def test_evaluation_covers_every_entry_unless_a_sample_is_asked_for(spark):
    logs = spark.range(150).select("id", F.lit("code_generation").alias("task_type"), F.lit("old").alias("old_output"), F.lit(0.5).alias("weight"),
                                   F.lit(True).alias("has_cases"), F.array(F.lit(1.0), F.lit(0.0)).alias("old_vec"))
    outputs = logs.select("id", F.lit("new").alias("output"), F.array(F.lit(0.0), F.lit(1.0)).alias("new_vec"))
    runs = logs.select("id", F.explode(F.array(F.lit("old"), F.lit("new"))).alias("side")).withColumn(
        "outcome", F.when(F.col("side") == "old", "passed").otherwise("failed"))
    marks = spark.createDataFrame([], "id long, side string, ordering int, correctness int, clarity int, completeness int")
    results, card = evaluation.evaluate(logs, outputs, runs, marks)
    row = card.first()
    assert results.where("regressed").count() == 150 and (row.total, row.regressions, row.weighted_regression) == (150, 150, 75.0)
    assert evaluation.evaluate(logs, outputs, runs, marks, sample=100)[1].first().total == 100


def test_evidence_is_told_apart_by_its_whole_content(spark):
    kind = "patient_id long, content string, place long"
    found = spark.createDataFrame([(1, "x" * 100 + "a", 0), (1, "x" * 100 + "b", 1), (1, "x" * 100 + "a", 2)], kind)
    assert sorted(r.place for r in clinical.merge_evidence(found, found.limit(0)).collect()) == [0, 1]
    assert [r.place for r in clinical.merge_evidence(found, found.limit(0), max_chars=100).collect()] == [0]


def test_rules_see_drugs_beyond_the_newest_twenty(spark):
    rule = next(r for r in clinical.rule_table(spark).collect() if r.metric is None)
    names = [rule.drug_a, *[f"other{i}" for i in range(30)], rule.drug_b]
    nodes = spark.createDataFrame([(f"n{i}", "drug", n, None, None, None, dt.date(2024, 1, 1)) for i, n in enumerate(names)],
                                  "node_id string, kind string, name string, code string, value double, unit string, date date")
    edges = spark.createDataFrame([(1, f"n{i}", "PRESCRIBED", dt.date(2024, 1, 1) + dt.timedelta(i)) for i in range(len(names))],
                                  "patient_id long, node_id string, edge string, date date")
    hits = spark.createDataFrame([], "patient_id long, source_id string, content string, confidence double, place int")
    _, warnings = graph.hybrid(nodes, edges, hits, clinical.rule_table(spark), clinical.alias_table(spark))
    assert rule.rule_id in [r.rule_id for r in warnings.collect()]
