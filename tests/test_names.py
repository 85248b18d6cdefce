"""Names of several words in any script, against a plain scan."""

import random

from pyspark.sql import functions as F

from tracemill.operators import documents

NAMES = [("Federal Reserve", "ORG"), ("Reserve", "ORG"), ("Federal Reserve Bank", "ORG"), ("Zürich", "GPE"), ("Łódź", "GPE"), ("São Paulo", "GPE"),
         ("U.S.", "GPE"), ("Jean-Luc", "PERSON"), ("Reserve Fund", "ORG"), ("paris", "GPE"), ("Paris", "PERSON"), ("Москва", "GPE"), ("  ", "ORG"), (None, "ORG"), ("Skipped", "OTHER")]


def test_names_of_several_words(spark):
    known = spark.createDataFrame(NAMES, "name string, label string")
    texts = {
        1: "The Federal Reserve met. Federal. Reserve", 2: "A FEDERAL  reserve Bank in Zürich and Łódź, São\nPaulo or São Paulo",
        3: "U.S. rates; Jean-Luc spoke of the Federal Reserve Fund", 4: "paris and Paris, Москва, Skipped", 5: None, 6: "", 7: "Reserve",
    }
    docs = spark.createDataFrame(list(texts.items()), "id long, body string").withColumn("name", F.lit("clash"))
    got = {}
    for r in documents.named_spans(docs, "id", "body", known).collect():
        got.setdefault(r.id, []).append((r.start, r.name, r.label))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [(1, "federal reserve", "ORG"), (7, "reserve", "ORG")],
        2: [(1, "federal reserve bank", "ORG"), (5, "zürich", "GPE"), (7, "łódź", "GPE"), (13, "são paulo", "GPE")],
        3: [(0, "u . s .", "GPE"), (6, "jean luc", "PERSON"), (11, "federal reserve", "ORG"), (12, "reserve fund", "ORG")],
        4: [(2, "paris", "GPE"), (2, "paris", "PERSON"), (4, "москва", "GPE")], 7: [(0, "reserve", "ORG")],
    }
    lower = documents.named_spans(docs, "id", "body", known, capital=False).where("id = 4 AND start = 0")
    assert {r.label for r in lower.collect()} == {"GPE", "PERSON"}
    assert documents.named_spans(docs, "id", "body", known.limit(0)).count() == 0
    marked = documents.with_entities(docs, "id", "body", known, find=documents.phrase_rows)
    assert marked.count() == len(texts) and {r.id for r in marked.where("fingerprint <> ''").collect()} == {1, 2, 3, 4, 7}


def test_names_equal_a_plain_scan(spark):
    rng = random.Random(5)
    vocabulary = ["Aa", "Bé", "Cж", "dd", "."]
    names = {tuple(rng.choice(vocabulary[:4]).lower() for _ in range(rng.randint(1, 4))) for _ in range(25)}
    docs = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]) for i in range(40)]
    want = set()
    for i, words in docs:
        low = [w.lower() for w in words]
        spans = [(a, b) for a in range(len(low)) for b in range(a + 1, len(low) + 1) if tuple(low[a:b]) in names and words[a][0].isupper()]
        want |= {(i, a, b - a) for a, b in spans if not any(c <= a and b <= d and (c, d) != (a, b) for c, d in spans)}
    known = spark.createDataFrame([(" ".join(n), "ORG") for n in names], "name string, label string")
    found = documents.named_spans(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "id long, body string"), "id", "body", known)
    assert {(r.id, r.start, r.length) for r in found.collect()} == want and found.count() == len(want)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
