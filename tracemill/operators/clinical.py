"""Clinical records: labs, drug rules, evidence, timelines, patient ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.config import CLINICAL, Clinical
from tracemill.functions import dates, scores, text
from tracemill.operators.relational import merge_old_first
from tracemill.operators.skew import latest_per, next_row, previous_row, small_side, top_per

# Reference ranges, units and codes per test; drug rules and aliases.
LAB_REFERENCE = (
    ("egfr", 60.0, 120.0, "mL/min/1.73m2", "48642-3"),
    ("creatinine", 0.6, 1.2, "mg/dL", "2160-0"),
    ("bun", 7.0, 25.0, "mg/dL", "3094-0"),
    ("hemoglobin", 12.0, 17.5, "g/dL", "718-7"),
    ("hba1c", 4.0, 5.7, "%", "4548-4"),
    ("glucose", 70.0, 100.0, "mg/dL", "2339-0"),
    ("sodium", 136.0, 145.0, "mEq/L", "2951-2"),
    ("potassium", 3.5, 5.0, "mEq/L", "2823-3"),
    ("alt", 7.0, 56.0, "U/L", "1742-6"),
    ("ast", 10.0, 40.0, "U/L", "1920-8"),
    ("total_cholesterol", 0.0, 200.0, "mg/dL", "2093-3"),
    ("ldl", 0.0, 100.0, "mg/dL", "2089-1"),
    ("hdl", 40.0, 99999.0, "mg/dL", "2085-9"),
    ("triglycerides", 0.0, 150.0, "mg/dL", "2571-8"),
    ("tsh", 0.4, 4.0, "mIU/L", "3016-3"),
    ("wbc", 4.5, 11.0, "K/uL", "6690-2"),
    ("platelets", 150.0, 400.0, "K/uL", "777-3"),
)
# drug_a, drug_b, kind, severity, source, recommendation, metric, threshold
DRUG_RULES = (
    ("metformin", "contrast_dye", "contraindication", "high", "RxNorm:861004",
     "Hold metformin 48h before and after contrast administration.", None, None),
    ("metformin", "egfr_threshold", "dose_restriction", "high", "RxNorm:860975",
     "Metformin contraindicated if eGFR < 30; dose reduce if eGFR 30-45.", "egfr", 30.0),
    ("warfarin", "aspirin", "interaction", "moderate", "RxNorm:202421",
     "Increased bleeding risk. Monitor INR closely.", None, None),
    ("ace_inhibitor", "potassium_sparing_diuretic", "interaction", "high", "RxNorm:241793",
     "Risk of hyperkalemia. Monitor serum potassium weekly.", None, None),
    ("nsaid", "ace_inhibitor", "interaction", "moderate", "RxNorm:253374",
     "NSAIDs reduce ACE inhibitor effectiveness and increase renal risk.", None, None),
    ("ssri", "tramadol", "interaction", "high", "RxNorm:861016",
     "Risk of serotonin syndrome. Avoid combination.", None, None),
    ("statin", "gemfibrozil", "contraindication", "high", "RxNorm:861022",
     "Avoid simvastatin/lovastatin + gemfibrozil. Rhabdomyolysis risk.", None, None),
    ("quinolone", "antacid", "interaction", "moderate", "RxNorm:253380",
     "Antacids reduce quinolone absorption. Separate by 2-4h.", None, None),
)
DRUG_ALIASES = {
    "ace_inhibitor": ("lisinopril", "enalapril", "ramipril", "captopril", "perindopril"),
    "nsaid": ("ibuprofen", "naproxen", "diclofenac", "celecoxib", "indomethacin"),
    "ssri": ("fluoxetine", "sertraline", "escitalopram", "paroxetine", "citalopram"),
    "statin": ("atorvastatin", "rosuvastatin", "simvastatin", "pravastatin", "lovastatin"),
    "quinolone": ("ciprofloxacin", "levofloxacin", "moxifloxacin", "ofloxacin"),
    "potassium_sparing_diuretic": ("spironolactone", "eplerenone", "triamterene", "amiloride"),
    "contrast_dye": ("iodinated_contrast", "gadolinium", "contrast"),
    "antacid": ("calcium_carbonate", "magnesium_hydroxide", "aluminum_hydroxide", "antacid"),
}
# End of fixed values.


def reference_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LAB_REFERENCE, "test_key string, low double, high double, ref_unit string, loinc string")


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(number, *rule) for number, rule in enumerate(DRUG_RULES)]
    return spark.createDataFrame(rows, (
        "rule_id int, drug_a string, drug_b string, kind string, severity string, source string, "
        "recommendation string, metric string, threshold double"
    ))


def alias_table(spark: SparkSession) -> DataFrame:
    rows = [(alias, name) for name, aliases in DRUG_ALIASES.items() for alias in {*aliases, name}]
    return spark.createDataFrame(sorted(rows), "name string, drug_class string")


def lab_key(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def lab_reference(labs: DataFrame, reference: DataFrame) -> DataFrame:
    """Range, unit and code of each test; an unknown test has none."""
    return labs.withColumn("test_key", lab_key(F.col("test_name"))).join(small_side(reference), "test_key", "left")


def lab_results(labs: DataFrame, reference: DataFrame) -> DataFrame:
    """Labs with abnormal flag, severity, unit and the change from ``previous_value``."""
    ranged = lab_reference(labs, reference)
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    return (
        ranged.withColumn("abnormal", F.coalesce(~value.between(low, high), F.lit(False)))
        .withColumn("severity", scores.lab_severity(value, low, high))
        .withColumn("unit", F.coalesce(F.when(F.col("unit") != "", F.col("unit")), "ref_unit", F.lit("")))
        .withColumn("delta", value - F.col("previous_value"))
        .drop("ref_unit")
    )


def finding_rollup(results: DataFrame, *keys: str) -> DataFrame:
    """Any abnormal, worst severity and specialists per finding."""
    flags = scores.lab_specialists(F.col("test_key"), F.col("abnormal"))
    worst = F.max(scores.severity_rank(F.col("severity")))
    names = F.array(*[F.lit(s) for s in scores.SEVERITIES])
    return results.groupBy(*keys).agg(
        F.bool_or("abnormal").alias("abnormal"),
        F.element_at(names, (worst + 1).cast("int")).alias("severity"),
        # A handful of specialist names, however many rows.
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(flags)))).alias("specialists"),
    )


LAB_ORDER = ("ts", "lab_id")


def _lab_bucket() -> Column:
    return F.date_trunc("minute", "ts")


def lab_edges(labs: DataFrame) -> DataFrame:
    """Edge from each lab value to the next of the same patient and test, with the gap in days."""
    linked = next_row(
        labs, ["patient_id", "test_name"], [F.col(c) for c in LAB_ORDER], _lab_bucket(), ["lab_id", "ts"], "_next"
    ).where(F.col("_next").isNotNull())
    return linked.select(
        "patient_id", "test_name", F.col("lab_id").alias("from_lab"), F.col("_next.lab_id").alias("to_lab"),
        F.datediff(F.to_date("_next.ts"), F.to_date("ts")).alias("gap_days"),
    )


def lab_deltas(labs: DataFrame, test: str | None = None) -> DataFrame:
    """Previous and current value, change and days between, per patient and test (name in any case)."""
    rows = labs.where(F.lower("test_name") == test.lower()) if test else labs
    linked = previous_row(
        rows, ["patient_id", "test_name"], [F.col(c) for c in LAB_ORDER], _lab_bucket(), ["value", "ts"], "_prev"
    ).where(F.col("_prev").isNotNull())
    return linked.select(
        "patient_id", "test_name", "lab_id", F.col("_prev.value").alias("previous"), F.col("value").alias("current"),
        (F.col("value") - F.col("_prev.value")).alias("delta"),
        F.datediff(F.to_date("ts"), F.to_date("_prev.ts")).alias("days_between"),
    )


def lab_trend(labs: DataFrame, test: str, last: int | None = None) -> DataFrame:
    """Values of one test per patient, oldest first; ``last`` keeps the newest ones."""
    rows = labs.where(F.lower("test_name") == test.lower())
    if last:
        rows = top_per(rows, ["patient_id"], [F.col(c).desc() for c in LAB_ORDER], last, "_back").drop("_back")
    return rows.orderBy("patient_id", *LAB_ORDER)


def latest_labs(labs: DataFrame) -> DataFrame:
    """Newest value per patient and test."""
    return latest_per(labs.select("patient_id", "test_name", "value", *LAB_ORDER), ["patient_id", "test_name"], [F.col(c) for c in LAB_ORDER])


def drug_key(name: Column) -> Column:
    return F.translate(F.lower(name), "- ", "__")


def drug_classes(drugs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct (patient_id, drug_class): each drug under its own name and its classes."""
    named = drugs.select("patient_id", drug_key(F.col("drug")).alias("name")).distinct()
    classed = named.join(small_side(aliases), "name").select("patient_id", "drug_class")
    return named.select("patient_id", F.col("name").alias("drug_class")).unionByName(classed).distinct()


def interactions(drugs: DataFrame, labs: DataFrame, rules: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rules that hold for a patient: both drugs taken, or the drug taken and the lab under its threshold.

    ``labs`` has the newest (patient_id, test_name, value). Rules meet classes
    by name and are counted per patient, so no drug pairs are formed.
    """
    classes = drug_classes(drugs, aliases)
    sides = rules.select("rule_id", F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("drug_a").alias("drug_class")),
        F.struct(F.lit("b").alias("side"), F.col("drug_b").alias("drug_class")),
    )).alias("_s")).select("rule_id", "_s.side", "_s.drug_class")
    met = classes.join(small_side(sides), "drug_class").groupBy("patient_id", "rule_id").agg(
        F.bool_or(F.col("side") == "a").alias("_a"), F.bool_or(F.col("side") == "b").alias("_b")
    ).where("_a")
    ruled = met.join(small_side(rules), "rule_id")
    values = labs.select("patient_id", lab_key(F.col("test_name")).alias("metric"), F.col("value").alias("_actual"))
    joined = ruled.join(values, ["patient_id", "metric"], "left")
    holds = F.when(F.col("metric").isNull(), F.col("_b")).otherwise(F.coalesce(F.col("_actual") < F.col("threshold"), F.lit(False)))
    shown = F.when(F.col("metric").isNull(), F.col("drug_b")).otherwise(
        F.concat("metric", F.lit(" < "), F.col("threshold").cast("string"))
    )
    return joined.where(holds).select(
        "patient_id", "rule_id", "drug_a", shown.alias("drug_b"), "kind", "severity", "source", "recommendation"
    )


def rank_evidence(evidence: DataFrame, as_of: Column, cfg: Clinical = CLINICAL) -> DataFrame:
    """Confidence weighted by source and age, and its tier."""
    days = F.datediff(F.to_date(as_of), "finding_date")
    ranked = evidence.withColumn(
        "confidence", scores.evidence_confidence(F.col("confidence"), F.col("source_type"), days)
    )
    return ranked.withColumn("tier", scores.confidence_tier(F.col("confidence"), cfg))


def by_tier(evidence: DataFrame, key: str) -> DataFrame:
    """Evidence counts per tier and the best confidence in each."""
    columns = []
    for tier in ("HIGH", "MEDIUM", "LOW"):
        inside = F.col("tier") == tier
        columns += [
            F.count_if(inside).alias(tier.lower()), F.max(F.when(inside, F.col("confidence"))).alias(f"best_{tier.lower()}")
        ]
    return evidence.groupBy(key).agg(*columns)


def consults(evidence: DataFrame, warnings: DataFrame, key: str = "patient_id") -> DataFrame:
    """Sorted distinct specialists per key, plus pharmacology when a serious drug warning exists."""
    serious = warnings.where(F.col("severity").isin("critical", "high")).select(
        key, F.lit("clinical_pharmacology").alias("specialist")
    ).distinct()
    named = evidence.select(key, F.explode("specialists").alias("specialist")).unionByName(serious).distinct()
    listed = named.groupBy(key).agg(F.sort_array(F.collect_set("specialist")).alias("consults"))
    return evidence.select(key).distinct().join(listed, key, "left").withColumn(
        "consults", F.coalesce("consults", F.array().cast("array<string>"))
    )


def merge_evidence(graph: DataFrame, vector: DataFrame, key: str = "patient_id", max_chars: int | None = None) -> DataFrame:
    """Both evidence tables, one row per key and content (or its first ``max_chars``): graph before vector, then by place."""
    both = graph.withColumn("_part", F.lit(0)).unionByName(vector.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    start = both.withColumn("_start", F.substring("content", 1, max_chars) if max_chars else F.col("content"))
    return latest_per(start, [key, "_start"], [F.col("_part"), F.col("place")], newest=False).drop("_start", "_part")


def merge_timeline(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old findings and the new ones with an id not there yet; order by date when reading."""
    return merge_old_first(old, new, "finding_id")


def lost_values(before: Column, after: Column) -> Column:
    """Medical values of the first text that the second lacks."""
    return F.array_except(text.medical_values(before), text.medical_values(after))


def deidentify(notes: DataFrame, body: str, patient: str) -> DataFrame:
    """Dates shifted, names redacted, and a check that no medical value was lost.

    The length check compares with the original text (white space collapsed).
    """
    clean = text.redact_names(dates.shift_text_dates(F.col(body), F.col(patient)))
    done = notes.withColumn("clean_text", clean)
    before = F.length(F.regexp_replace(body, r"(?U)\s+", " "))
    drift = F.abs(F.length(F.regexp_replace("clean_text", r"(?U)\s+", " ")) - before) / before
    return (
        done.withColumn("lost", lost_values(F.col(body), F.col("clean_text")))
        .withColumn("integrity_ok", F.size("lost") == 0)
        .withColumn("length_drift", F.when(before > 0, drift).otherwise(0.0))
    )


def encode_timeline(entities: DataFrame, labs: DataFrame, first_labs: int = 10) -> DataFrame:
    """One summary text per patient: sorted distinct conditions and drugs, the first abnormal labs by date.

    ``entities``: (patient_id, entity_type, name); ``labs``: lab results with ts and lab_id.
    """
    distinct = entities.select("patient_id", F.upper("entity_type").alias("kind"), "name").where(
        F.col("kind").isin("CONDITION", "DRUG")
    ).distinct()
    names = distinct.groupBy("patient_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("kind") == "CONDITION", F.col("name")))), ", ").alias("_conditions"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("kind") == "DRUG", F.col("name")))), ", ").alias("_drugs"),
    )
    head = top_per(labs.where("abnormal"), ["patient_id"], [F.col(c) for c in LAB_ORDER], first_labs, "_n")
    shown = F.concat("test_name", F.lit(":"), F.col("value").cast("string"), "unit")
    abnormal = head.groupBy("patient_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", shown.alias("t")))), lambda s: s["t"]), "; ").alias("_labs")
    )
    patients = entities.select("patient_id").unionByName(labs.select("patient_id")).distinct()
    parts = F.concat_ws(
        " | ",
        F.when(F.coalesce("_conditions", F.lit("")) != "", F.concat(F.lit("Conditions: "), "_conditions")),
        F.when(F.coalesce("_drugs", F.lit("")) != "", F.concat(F.lit("Medications: "), "_drugs")),
        F.when(F.coalesce("_labs", F.lit("")) != "", F.concat(F.lit("Abnormal labs: "), "_labs")),
    )
    return patients.join(names, "patient_id", "left").join(abnormal, "patient_id", "left").select(
        "patient_id", F.when(parts == "", "No structured findings").otherwise(parts).alias("summary")
    )


def finding_text(raw: Column, entities: Column, labs: Column, max_chars: int | None = None) -> Column:
    """Raw text, entities and labs (with an abnormal mark) joined by bars, empty parts left out.

    ``entities``: array of (entity_type, value); ``labs``: array of (test_name, value, unit, abnormal).
    """
    named = F.transform(entities, lambda e: F.concat(e["entity_type"], F.lit(": "), e["value"]))
    measured = F.transform(labs, lambda r: F.concat(
        r["test_name"], F.lit(": "), r["value"].cast("string"), F.lit(" "), r["unit"],
        F.when(r["abnormal"], " [ABNORMAL]").otherwise(""),
    ))
    parts = F.filter(F.concat(F.array(F.coalesce(raw, F.lit(""))), named, measured), lambda p: p != "")
    joined = F.array_join(parts, " | ")
    return F.substring(joined, 1, max_chars) if max_chars else joined
