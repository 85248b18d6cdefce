"""Text expressions: cleaning, sentences, topics, entities, redaction, parsing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keyword tables, labels and patterns.
TOPICS = {
    "politics": ("president", "congress", "senate", "parliament", "government", "election", "vote", "policy", "law"),
    "finance": ("stock", "market", "earnings", "federal reserve", "gdp", "inflation", "interest rate", "ipo", "fund"),
    "sports": ("championship", "tournament", "goal", "score", "match", "game", "player", "team", "season"),
    "technology": ("ai", "artificial intelligence", "startup", "software", "chip", "data", "cloud", "cybersecurity"),
    "health": ("vaccine", "drug", "clinical trial", "fda", "hospital", "pandemic", "outbreak", "treatment"),
    "climate": ("climate", "carbon", "emissions", "renewable", "solar", "wind", "fossil fuel", "temperature"),
    "breaking_news": ("breaking", "urgent", "flash", "just in", "developing"),
}
VOLATILE_KEYWORDS = (
    "election", "elections", "vote", "voting", "ballot",
    "federal reserve", "rate decision", "interest rate",
    "breaking", "emergency", "attack", "explosion",
    "market crash", "stock market", "earnings",
    "war", "conflict", "ceasefire", "invasion",
    "earthquake", "hurricane", "tornado", "flood",
    "assassination", "coup",
)
ENTITY_LABELS = ("PERSON", "ORG", "GPE", "NORP", "EVENT", "FAC", "LOC", "DATE")
DOC_TYPE_CODES = {"case_law": "CR", "statute": "ST", "regulation": "RG", "contract": "CN", "advisory": "AV"}
SECTION_PATTERN = r"^(#+\s+.+|[A-Z][A-Z\s]+:)"
TITLED_NAME = r"\b(?:Dr\.?|Mr\.?|Mrs\.?|Ms\.?)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b"
PAIRED_NAME = r"\b[A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b"
MEDICAL_VALUE = r"\b\d+\.?\d*\s*(?:mg|mcg|mEq|mmol|mg/dL|g/dL|U/L|IU/L|mL|L|mmHg|bpm|%|ng/mL|pg/mL|pmol/L|nmol/L)\b"
ICD_CODE = r"\b[A-Z]\d{2}(?:\.\d{1,4})?\b"
LOINC_CODE = r"\b\d{3,5}-\d\b"
LAB_ENTRY = r"([A-Za-z][A-Za-z0-9\s_/]+?):\s*([\d.]+)\s*([A-Za-z/%]+(?:/[A-Za-z0-9]+)?)?"
ECG_WORDS = ("rhythm", "sinus", "bpm", "ecg", "ekg", "qt interval")
IMAGING_WORDS = ("mri", "ct scan", "x-ray", "ultrasound", "imaging", "radiology")
MODALITIES = ("text", "lab", "imaging", "ecg", "pathology")
# End of fixed values.

# Typed placeholders of the regex-based redaction, applied in this order.
PII_PATTERNS = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "CREDIT_CARD": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "US_SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "IP_ADDRESS": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "PHONE_NUMBER": r"\+?\d{1,3}[ -]\(?\d{3}\)?[ -]\d{3}[ -]\d{4}\b",
}


def unicode_regex(pattern: str, ignore_case: bool = False, dot_all: bool = False) -> str:
    """Java pattern whose classes, boundaries and case folding cover all of Unicode."""
    return f"(?{'iu' if ignore_case else ''}U{'s' if dot_all else ''}){pattern}"


def any_of(words) -> str:
    """Alternation of literal words."""
    return "|".join(w.replace(".", r"\.") for w in words)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside branches that may be skipped."""
    return F.element_at(F.transform(F.array(value), body), 1)


def contains_any(value: Column, words) -> Column:
    """True when a literal word occurs: plain byte search, much faster than a regex alternation."""
    return reduce(lambda a, b: a | b, [value.contains(w) for w in words])


def clean_text(text: Column) -> Column:
    """Tags to spaces, white space runs to one space, trimmed."""
    spaced = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"(?U)\s+", " ")
    return F.trim(spaced)


def html_to_text(html: Column, max_chars: int | None = None) -> Column:
    """Visible text of an HTML body: scripts, styles, comments and tags out, common entities decoded."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.substring(text, 1, max_chars) if max_chars else text


def sentences(text: Column, min_chars: int) -> Column:
    """Array of sentences longer than ``min_chars``, split after . ! or ? and white space."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    parts = F.transform(
        F.split(trimmed, r"(?U)(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    )
    return F.filter(parts, lambda s: F.length(s) > min_chars)


def section(paragraph: Column) -> Column:
    """Heading at the start of a paragraph: a ``#`` line or capitals before a colon; else empty."""
    return F.regexp_replace(
        F.regexp_extract(paragraph, r"(?U)" + SECTION_PATTERN, 1), r"(?U)^\s+|\s+$", ""
    )


def topics(text: Column) -> Column:
    """Array of topics with a keyword in the text, else ``["general"]``."""
    def tags(lowered: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(contains_any(lowered, words), F.lit(topic)) for topic, words in TOPICS.items()
        ]))

    return bind(
        bind(F.lower(text), tags), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))
    )


def is_volatile(topic_list: Column, text: Column) -> Column:
    """Breaking topic or a volatile keyword in the text."""
    return F.array_contains(topic_list, "breaking_news") | bind(
        F.lower(text), lambda lowered: contains_any(lowered, VOLATILE_KEYWORDS)
    )


def tier(volatile: Column) -> Column:
    return F.when(volatile, "hot").otherwise("warm")


def fingerprint(entities: Column) -> Column:
    """First 16 hex digits of the hash over sorted ``text:label`` pairs without dates; empty if none."""
    named = F.filter(entities, lambda e: e["label"] != "DATE")
    joined = F.array_join(F.sort_array(F.transform(named, lambda e: F.concat(F.lower(e["text"]), F.lit(":"), e["label"]))), "|")
    return F.when(joined == "", "").otherwise(F.substring(F.sha2(joined, 256), 1, 16))


def id_part(part: Column) -> Column:
    """Upper case, letters and digits only, at most 8 characters."""
    return F.substring(F.regexp_replace(F.upper(part), "[^A-Z0-9]", ""), 1, 8)


def document_id(country: Column, state: Column, district: Column, year: Column,
                doc_type: Column, serial: Column, version: Column) -> Column:
    """``country:state:district:year:type:serial:vN``."""
    codes = F.create_map(*[F.lit(v) for pair in DOC_TYPE_CODES.items() for v in pair])
    return F.concat_ws(
        ":", id_part(country), id_part(state), id_part(district), year.cast("string"),
        F.coalesce(codes[doc_type], F.lit("XX")), id_part(serial), F.concat(F.lit("v"), version.cast("string")),
    )


def chunk_id(document: Column, index: Column) -> Column:
    """Document id and a position of at least four digits."""
    digits = index.cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.concat_ws(":", document, padded)


def base_id(document: Column) -> Column:
    """Document id without what follows its last ``:v``."""
    return F.regexp_replace(document, r"(?s)^(.*):v.*$", "$1")


def bump_version(document: Column) -> Column:
    """Document id with the version raised by one; ``:v2`` is added when there is none."""
    version = F.regexp_extract(document, r":v(\d+)$", 1)
    return F.when(version == "", F.concat(document, F.lit(":v2"))).otherwise(
        F.concat(base_id(document), F.lit(":v"), (version.cast("bigint") + 1).cast("string"))
    )


def citation(document: Column, heading: Column, page: Column) -> Column:
    """Document, section and page joined by a bar, empty parts left out."""
    return F.concat_ws(
        " | ", document, F.when(heading != "", heading),
        F.when(page.isNotNull(), F.concat(F.lit("p."), page.cast("string"))),
    )


def fenced(text: Column, kind: str) -> Column:
    """Content of the first code (``code``) or diff (``diff``) fence, else the whole text; trimmed."""
    fence = r"```(?:\w+)?\n(.*?)```" if kind == "code" else r"```(?:diff|patch)?\n(.*?)```"
    pattern = unicode_regex(fence, dot_all=True)
    inner = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)
    return F.regexp_replace(inner, r"(?U)^\s+|\s+$", "")


def redact_names(text: Column) -> Column:
    """Titles with names, then capitalised word pairs, replaced by ``[PERSON]``."""
    once = F.regexp_replace(text, unicode_regex(TITLED_NAME), "[PERSON]")
    return F.regexp_replace(once, unicode_regex(PAIRED_NAME), "[PERSON]")


def redact_pii(text: Column) -> Column:
    """Struct (text, found): typed placeholders such as ``<EMAIL_ADDRESS>`` and how many were put in."""
    current = text
    for name, pattern in PII_PATTERNS.items():
        current = F.regexp_replace(current, pattern, f"<{name}>")
    # No pattern matches into a placeholder, so those that the text had itself are still there.
    marks = F.lit(f"<(?:{'|'.join(PII_PATTERNS)})>")
    return F.struct(current.alias("text"), (F.regexp_count(current, marks) - F.regexp_count(text, marks)).alias("found"))


def medical_values(text: Column) -> Column:
    """Sorted distinct numbers with units (lower case), ICD codes and LOINC codes."""
    amounts = F.transform(
        F.regexp_extract_all(text, F.lit(unicode_regex(MEDICAL_VALUE, True)), F.lit(0)),
        lambda v: F.lower(F.trim(v)),
    )
    icd = F.regexp_extract_all(text, F.lit(unicode_regex(ICD_CODE)), F.lit(0))
    loinc = F.regexp_extract_all(text, F.lit(unicode_regex(LOINC_CODE)), F.lit(0))
    return F.array_sort(F.array_distinct(F.flatten(F.array(amounts, icd, loinc))))


def parse_labs(text: Column) -> Column:
    """Array of structs (test_name, value, unit) from ``name: number unit`` text; bad numbers left out."""
    pattern = F.lit(unicode_regex(LAB_ENTRY, True))
    parts = [F.regexp_extract_all(text, pattern, F.lit(i)) for i in (1, 2, 3)]
    rows = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("name", "number", "unit"))]), lambda r: F.struct(
        F.replace(F.lower(F.regexp_replace(r["name"], r"(?U)^\s+|\s+$", "")), F.lit(" "), F.lit("_")).alias("test_name"),
        r["number"].try_cast("double").alias("value"),
        r["unit"].alias("unit"),
    ))
    return F.filter(rows, lambda r: r["value"].isNotNull())


def modality(explicit: Column, content: Column, has_labs: Column) -> Column:
    """Route of a record: explicit tag, ECG words, imaging words, lab keys or panel, else text."""
    tag = F.lower(explicit)
    return F.when(tag.isin(*MODALITIES), tag).otherwise(bind(F.lower(content), lambda lowered: (
        F.when(contains_any(lowered, ECG_WORDS), "ecg")
        .when(contains_any(lowered, IMAGING_WORDS), "imaging")
        .when(has_labs | lowered.startswith("lab panel"), "lab")
        .otherwise("text")
    )))


def unwrap_fence(answer: Column) -> Column:
    """Strip a surrounding code fence (its first line and what follows the last fence)."""
    trimmed = F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")
    body = F.regexp_replace(F.regexp_replace(trimmed, r"(?s)^[^\n]*\n", ""), r"(?s)^(.*)```.*$", "$1")
    return F.when(trimmed.startswith("```"), body).otherwise(trimmed)


def parse_answer(answer: Column, schema: T.StructType | str) -> Column:
    """Struct parsed from a JSON answer, null when it is not valid JSON for ``schema``."""
    return F.from_json(unwrap_fence(answer), schema, {"mode": "PERMISSIVE"})
