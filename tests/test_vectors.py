"""Vector search in tiny chunks and pivot cells against brute force."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracemill.operators import articles, retrieval, vector_index, vectors


def clustered(count=260, dims=12, seed=5):
    """Vectors around a few centres; a third are copies of one vector, some are zero."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    data = centres[rng.integers(0, 6, count)] + 0.2 * rng.normal(size=(count, dims))
    data[: count // 3] = data[0]
    data[count - 3:] = 0
    return data.astype(np.float32)


def brute(data, ids, k, floor, groups=None, self_ok=True):
    unit = data.astype(float)
    norms = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = np.divide(unit, norms, out=np.zeros_like(unit), where=norms > 0)
    scores = np.round(unit @ unit.T, 6) + 0.0
    found = {}
    for q in range(len(ids)):
        rows = [(-scores[q, b], ids[b]) for b in range(len(ids)) if (groups is None or groups[q] == groups[b])
                and (floor is None or scores[q, b] >= floor) and (self_ok or q != b)]
        found[ids[q]] = [(i, -s) for s, i in sorted(rows)[:k]]
    return found


@pytest.mark.parametrize("floor", [None, 0.85])
@pytest.mark.parametrize(("chunk_rows", "sent"), [(16, 0), (4096, 0), (4096, 50_000)])
@pytest.mark.parametrize("grouped", [False, True])
def test_nearest_equals_brute_force(spark, monkeypatch, floor, chunk_rows, sent, grouped):
    monkeypatch.setattr(vectors, "SENT_QUERIES", sent)
    data = clustered()
    groups = [0 if i % 3 else i % 5 for i in range(len(data))]
    rows = [(i, groups[i], data[i].tolist()) for i in range(len(data))]
    df = spark.createDataFrame(rows, "query_id long, g long, vec array<float>")
    got = vectors.nearest(
        df, df.withColumnRenamed("query_id", "base_id"), 4, floor, ("g",) if grouped else (), exclude_self=True, chunk_rows=chunk_rows
    ).collect()
    want = brute(data, list(range(len(data))), 4, floor, groups if grouped else None, self_ok=False)
    found = {i: [] for i in want}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.base_id, r.score))
    assert {i: [b for b, _ in v] for i, v in found.items()} == {i: [b for b, _ in v] for i, v in want.items()}


def test_cosine_of_a_zero_vector_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(F.round(vectors.cosine(F.col("a"), F.col("b")), 9)).collect()]
    assert got == [0.0, 1.0]


def rows_for_supersede(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    data = [
        (1, "f", 0, v, False), (2, "f", 240, v, False), (3, "f", 300, v, False), (4, "f", 900, v, False),
        (5, "f", 5000, w, False), (6, "", 9000, v, False), (7, "g", 0, v, True), (8, "g", 900, v, False),
    ]
    return spark.createDataFrame(data, "article_id long, fingerprint string, s long, embedding array<double>, stale boolean").withColumn(
        "published_at", F.timestamp_seconds("s")
    )


@pytest.mark.parametrize("chunk_rows", [2, 4096])
def test_supersede_takes_the_first_newer_article_after_the_gap(spark, chunk_rows):
    got = {r.article_id: r.superseded_by for r in articles.supersede(rows_for_supersede(spark), chunk_rows=chunk_rows).collect()}
    assert got == {1: 3, 2: 4, 3: 4}


@pytest.mark.parametrize("cell_rows", [8, 4096])
@pytest.mark.parametrize("floor", [None, 0.85])
def test_index_equals_brute_force(spark, tmp_path, cell_rows, floor):
    data = clustered()
    df = spark.createDataFrame([(i, f"n{i}", data[i].tolist()) for i in range(len(data))], "id long, note string, vec array<float>").repartition(5)
    vector_index.build(df, str(tmp_path / "index"), "id", "vec", cell_rows)
    assert vector_index.stored_vectors(spark, str(tmp_path / "index")).select("id", "note").distinct().count() == len(data)
    got = {}
    for r in vector_index.search(spark, str(tmp_path / "index"), df.withColumnRenamed("id", "query_id"), 7, "id", "vec", min_score=floor).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    want = brute(data, list(range(len(data))), 7, floor)
    for q, rows in want.items():
        assert [(i, pytest.approx(s, abs=2e-6)) for i, s in rows] == [(i, s) for _, i, s in sorted(got.get(q, []))], q
    few = vector_index.search(spark, str(tmp_path / "index"), df.withColumnRenamed("id", "query_id"), 7, "id", "vec", probes=2).count()
    assert 0 < few <= sum(len(r) for r in brute(data, list(range(len(data))), 7, None).values())


def test_index_prunes_at_the_scan(spark, tmp_path):
    """Clusters far apart: a query reads the folders of its own cells only, and no vector is shuffled."""
    rng = np.random.default_rng(1)
    data = np.repeat(np.eye(12)[:8], 50, axis=0) + 0.02 * rng.normal(size=(400, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vec array<double>")
    vector_index.build(df, str(tmp_path / "index"), "id", "vec", 25)
    found = vector_index.search(spark, str(tmp_path / "index"), df.where("id = 3").withColumnRenamed("id", "query_id"), 5, "id", "vec")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "coarse" in plan.split("PartitionFilters: [")[1].split("]")[0] and "cell" in plan.split("PushedFilters: [")[1]
    read = set(found.inputFiles())
    files = set(vector_index.stored_vectors(spark, str(tmp_path / "index")).inputFiles())
    assert {r.id for r in found.collect()} <= set(range(50)) and found.count() == 5 and len(files) >= 2 and read <= files
    assert vector_index.search(spark, str(tmp_path / "index"), df.limit(0).withColumnRenamed("id", "query_id"), 5, "id", "vec").count() == 0


def test_index_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "id long, vec array<double>")
    vector_index.build(df, str(tmp_path / "index"), "id", "vec")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>")
    assert vector_index.search(spark, str(tmp_path / "index"), asked, 5, "id", "vec").count() == 0


@pytest.mark.parametrize("floor", [None, 0.85])
@pytest.mark.parametrize("chunk_rows", [1, 3, 4096])
def test_blocks_of_any_size_equal_brute_force(spark, monkeypatch, chunk_rows, floor):
    monkeypatch.setattr(vectors, "SENT_QUERIES", 0)
    monkeypatch.setattr(vectors, "STRIP", 7)
    monkeypatch.setattr(vectors, "COLUMNS", 11)
    monkeypatch.setattr(vectors, "PIVOT_ROWS", 5)
    data = clustered()
    rows = [(i, data[i].tolist()) for i in range(len(data))]
    df = spark.createDataFrame(rows, "query_id long, vec array<float>")
    got = vectors.nearest(df, df.withColumnRenamed("query_id", "base_id"), 4, floor, exclude_self=True, chunk_rows=chunk_rows).collect()
    found = {i: [] for i in range(len(data))}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.base_id, pytest.approx(r.score, abs=2e-6)))
    assert brute(data, list(range(len(data))), 4, floor, self_ok=False) == found


@pytest.mark.parametrize("floor", [None, 0.3])
def test_a_block_holds_no_scores_of_all_its_pairs(floor):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(24_000, 16))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    tracemalloc.start()
    rows, cols, _ = vectors.block_best(data[:2_000], data, np.arange(len(data)), 5, floor)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all scores would be 384 MB
    scores = np.round(data[:50] @ data.T, 6)
    for i in range(50):
        assert cols[rows == i].tolist() == np.lexsort((np.arange(len(data)), -scores[i]))[:5].tolist()


@pytest.mark.parametrize("sent", [0, 50_000])
def test_best_chunks_over_the_documents_of_a_query(spark, monkeypatch, sent):
    monkeypatch.setattr(vectors, "SENT_QUERIES", sent)
    data = clustered(120)
    df = spark.createDataFrame([(i, f"D{i % 7}", v.tolist()) for i, v in enumerate(data)], "chunk_id long, document_id string, embedding array<float>")
    asked = df.select(F.col("chunk_id").alias("query_id"), "embedding")
    matched = asked.select("query_id", F.explode(F.array(*[F.concat(F.lit("D"), (F.col("query_id") + i) % 7) for i in range(3)])).alias("document_id"))
    scores = np.round(vectors.unit_rows(pd.Series(list(data))) @ vectors.unit_rows(pd.Series(list(data))).T, 6)
    got = {}
    for r in sorted(retrieval.search_in_documents(asked, matched, df, 6, chunk_rows=2).collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r.document_id == f"D{r.chunk_id % 7}"
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for q in range(120):
        mine = [c for c in range(120) if (c - q) % 7 < 3]
        assert got[q] == sorted(mine, key=lambda c: (-scores[q, c], c))[:6]


@pytest.mark.parametrize(("floor", "probes"), [(None, None), (0.85, None), (None, 2)])
def test_index_takes_any_number_of_queries(spark, monkeypatch, tmp_path, floor, probes):
    data = clustered()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vec array<float>")
    vector_index.build(df, str(tmp_path / "index"), "id", "vec", 8)
    asked = df.withColumnRenamed("id", "query_id")
    want = vector_index.search(spark, str(tmp_path / "index"), asked, 7, "id", "vec", min_score=floor, probes=probes).collect()
    monkeypatch.setattr(vectors, "SENT_QUERIES", 3)
    monkeypatch.setattr(vector_index, "CHUNK_ROWS", 2)
    got = vector_index.search(spark, str(tmp_path / "index"), asked, 7, "id", "vec", min_score=floor, probes=probes).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_only_articles_that_can_supersede_meet(spark, monkeypatch):
    met = []

    def meet(left, right, *rest):
        met.append((sorted(r.article_id for r in left.collect()), sorted(r.article_id for r in right.collect())))
        return vectors.grid_join(left, right, *rest)

    monkeypatch.setattr(articles, "grid_join", meet)
    rows = [(1, "alone", 0), (2, "at once", 0), (3, "at once", 299), (4, "pair", 0), (5, "pair", 200), (6, "pair", 300), (7, "pair", None), (8, "", 0), (9, "", 900)]
    df = spark.createDataFrame([(i, f, s, False, [1.0, 0.0]) for i, f, s in rows], "article_id long, fingerprint string, s long, stale boolean, embedding array<float>")
    got = articles.supersede(df.withColumn("published_at", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")).collect()
    assert met == [([4], [6])]
    assert [tuple(r) for r in got] == [(4, 6, 1.0)]
