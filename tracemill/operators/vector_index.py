"""A stored vector index: cells around two levels of centres, written as partitions that a search prunes at the scan.

``build`` writes the vectors with their cell, the cells of one coarse centre in one partition folder, rows sorted by
cell. ``search`` asks the centres first: by the triangle inequality on angles a cell farther from the query than its
radius and the query's limit allow holds no match, so the scan reads the folders and cells that are left and the result
stays exact. ``probes`` visits only that many nearest cells instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators.skew import top_per
from tracemill.operators.vectors import BLOCK_CHUNKS, CHUNK_ROWS, SENT_HITS, STRIP, few_queries, nearest_over, sent_search, unit_rows

#: Vectors from which centres are learned: on the driver for the coarse ones, per coarse centre in a task for the fine ones.
SAMPLE = 16_384
#: Most cells of an index; beyond that cells hold more rows, and a search prunes less.
MOST_CELLS = 32_768
ROUNDS = 6
#: Most queries times cells that the driver looks at.
SENT_ANGLES = 8_000_000


def centres_of(vectors: np.ndarray, count: int) -> np.ndarray:
    """Unit centres of unit rows by spherical k-means, started from rows far apart."""
    vectors = vectors[np.linalg.norm(vectors, axis=1) > 0]
    if not len(vectors):
        return np.zeros((1, vectors.shape[1]))
    chosen, closeness = [0], vectors @ vectors[0]
    while len(chosen) < min(count, len(vectors)) and closeness.min() < 1 - 1e-9:
        chosen.append(int(closeness.argmin()))
        closeness = np.maximum(closeness, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen]
    for _ in range(ROUNDS):
        home = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, vectors)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def _nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scores = np.clip(vectors @ centres.T, -1.0, 1.0)
    at = scores.argmax(axis=1)
    return at, np.arccos(scores[np.arange(len(vectors)), at])


def build(base: DataFrame, path: str, base_id: str, vec: str, cell_rows: int = CHUNK_ROWS) -> None:
    """Write the index of all rows of ``base`` (columns ``base_id``, ``vec``, and the others as they are) under ``path``.

    Cells hold about ``cell_rows`` rows. Centres come from SAMPLE vectors with the least hashes (coarse) and as many
    of each coarse centre (fine); every row is indexed. Zero vectors lie in the first cell.
    """
    spark, columns = base.sparkSession, base.columns
    cells = min(MOST_CELLS, max(1, -(-base.count() // cell_rows)))
    coarse_count = max(1, round(cells ** 0.5))
    fine_count = -(-cells // coarse_count)
    drawn = base.select(vec).orderBy(F.xxhash64(vec), vec).limit(SAMPLE).toPandas()
    coarse = centres_of(unit_rows(drawn[vec]), coarse_count) if len(drawn) else np.zeros((1, 1))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(coarse=_nearest_centre(unit_rows(pdf[vec]), coarse)[0])

    placed = base.mapInPandas(place, T.StructType([*base.schema.fields, T.StructField("coarse", T.LongType())]))
    share = F.pmod(F.xxhash64(F.lit(3), F.col(vec)), F.lit(1_000_000))
    sizes = {r["coarse"]: r["count"] for r in placed.groupBy("coarse").count().collect()}
    wanted = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, min(1_000_000, SAMPLE * 1_000_000 // n + 1))]) if sizes else None

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        made = centres_of(unit_rows(pdf[vec]), fine_count)
        return pd.DataFrame({"coarse": [int(pdf["coarse"].iloc[0])] * len(made), "centre": list(made)})

    learned = placed.where(share < wanted[F.col("coarse")]).select("coarse", vec).groupBy("coarse").applyInPandas(learn, "coarse long, centre array<double>").toPandas() if sizes else pd.DataFrame()
    fine = {int(c): np.vstack(rows["centre"]) for c, rows in learned.groupby("coarse")} if len(learned) else {}
    fine = {c: fine.get(c, coarse[c:c + 1]) for c in sizes}

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c, rows in pdf.groupby("coarse", sort=False):
                at, angle = _nearest_centre(unit_rows(rows[vec]), fine[c])
                yield rows.assign(cell=c * MOST_CELLS + at, angle=angle)

    kinds = T.StructType([*placed.schema.fields, T.StructField("cell", T.LongType()), T.StructField("angle", T.DoubleType())])
    # ranges, not hashes, of cell and id: a cell that holds a third of all rows becomes many files
    settled = placed.mapInPandas(settle, kinds).repartitionByRange("coarse", "cell", F.xxhash64(base_id)).sortWithinPartitions("coarse", "cell")
    settled.write.partitionBy("coarse").parquet(f"{path}/vectors")
    settled.select(*columns, "cell", "angle", "coarse").limit(0).coalesce(1).write.parquet(f"{path}/kinds")  # an empty index has no other file
    radius = stored_vectors(spark, path).groupBy("coarse", "cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    centre = spark.createDataFrame([(c * MOST_CELLS + i, v.tolist()) for c, m in fine.items() for i, v in enumerate(m)], "cell long, centre array<double>")
    radius.join(centre, "cell").coalesce(1).write.parquet(f"{path}/cells")


def stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/kinds").schema).parquet(f"{path}/vectors")


def pruned(stored: DataFrame, cells: pd.DataFrame) -> DataFrame:
    """The rows of some cells: a condition on the partition folders and one on the sorted cells reach the scan."""
    return stored.where(F.col("coarse").isin(sorted(set(cells["coarse"].tolist()))) & F.col("cell").isin(sorted(cells["cell"].tolist())))


def search(
    spark: SparkSession, path: str, queries: DataFrame, k: int, base_id: str, vec: str, query_id: str = "query_id",
    min_score: float | None = None, probes: int | None = None,
) -> DataFrame:
    """Top ``k`` by cosine per query from a stored index: query_id, base_id, score, rank; exact unless ``probes`` is given.

    Few queries go to every task as one matrix; more meet the cells in blocks (``_search_blocks``). Scores are rounded to
    six decimals and ties go to the lower id. An empty index or no query gives no rows.
    """
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toPandas()
    asked = few_queries(queries.select(query_id, F.col(vec).alias("_vec")).distinct(), "_vec", max(k, -(-SENT_HITS * len(cells) // SENT_ANGLES)))
    stored = stored_vectors(spark, path)
    if asked is None and len(cells):
        return _search_blocks(stored, cells, queries.select(query_id, vec).distinct(), k, base_id, vec, query_id, min_score, probes)
    kind = {n: stored.schema[n].dataType.simpleString() for n in (base_id,)} | {query_id: queries.schema[query_id].dataType.simpleString()}
    schema = f"{query_id} {kind[query_id]}, {base_id} {kind[base_id]}, score double"
    if not len(cells) or not len(asked):
        return spark.createDataFrame([], schema + ", rank int")
    matrix = unit_rows(asked["_vec"])
    angle = np.arccos(np.clip(matrix @ np.vstack(cells["centre"]).T, -1.0, 1.0))

    def scan(visit: np.ndarray) -> DataFrame:
        """Hits from the cells that each query visits (queries x cells, true where visited)."""
        used = np.flatnonzero(visit.any(axis=0))
        by_cell = {(int(cells["cell"].iloc[c]),): np.flatnonzero(visit[:, c]) for c in used}
        base = pruned(stored, cells.iloc[used])
        return sent_search(base, asked[[query_id]], matrix, by_cell, ["cell"], base_id, vec, k, min_score, schema)

    order, size = np.argsort(angle, axis=1, kind="stable"), cells["n"].to_numpy()
    if probes is not None:
        home = np.zeros(angle.shape, bool)
        np.put_along_axis(home, order[:, :probes], True, axis=1)
        visit = home
    elif min_score is not None:
        visit = angle - cells["radius"].to_numpy() <= np.arccos(min(1.0, min_score)) + 1e-5
    else:
        # nearest cells until k rows are seen: the worst of these best k is no better than the true one
        before = np.cumsum(size[order], axis=1) - size[order]
        home = np.zeros(angle.shape, bool)
        np.put_along_axis(home, order, before < k, axis=1)
        first = top_per(scan(home), [query_id], [F.col("score").desc(), F.col(base_id)], k).groupBy(query_id).agg(F.min("score").alias("worst"), F.count("*").alias("n"))
        worst = {r[query_id]: r["worst"] for r in first.collect() if r["n"] == k}
        # a zero query is at right angles to all; scores are rounded, hence the margin
        limit = np.arccos(np.clip(np.array([worst.get(q, -1.0) for q in asked[query_id].tolist()]) - 1e-6, -1.0, 1.0))
        limit[~matrix.any(axis=1)] = np.pi
        visit = angle - cells["radius"].to_numpy() <= limit[:, None] + 1e-5
        if worst and min(worst.values()) <= 0:  # a vector without length scores 0 wherever it lies
            visit[limit >= np.pi / 2 - 1e-5] = True
    return top_per(scan(visit), [query_id], [F.col("score").desc(), F.col(base_id)], k)


def _search_blocks(
    stored: DataFrame, cells: pd.DataFrame, queries: DataFrame, k: int, base_id: str, vec: str, query_id: str,
    min_score: float | None, probes: int | None,
) -> DataFrame:
    """The same search for any number of queries: each goes once to every block of neighbouring cells that can hold a match.

    A task looks at one strip of queries and all centres. The nearest cells that hold ``k`` rows together, and their radii,
    bound the angle of the ``k``-th best without a scan. With ``probes`` a cell is a block.
    """
    centres, radius, size = np.vstack(cells["centre"]), cells["radius"].to_numpy(), cells["n"].to_numpy()
    number = np.unique(np.arange(len(cells)) if probes is not None else (np.cumsum(size) - size) // (BLOCK_CHUNKS * CHUNK_ROWS), return_inverse=True)[1]
    first = np.flatnonzero(np.diff(number, prepend=-1))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for begin in range(0, len(pdf), STRIP):
                some = pdf.iloc[begin:begin + STRIP]
                asked = unit_rows(some[vec])
                angle = np.arccos(np.clip(asked @ centres.T, -1.0, 1.0))
                if probes is not None:
                    wanted = np.zeros(angle.shape, bool)
                    np.put_along_axis(wanted, np.argsort(angle, axis=1, kind="stable")[:, :probes], True, axis=1)
                else:
                    if min_score is not None:
                        limit = np.full(len(some), np.arccos(min(1.0, min_score)))
                    else:
                        far = angle + radius
                        order = np.argsort(far, axis=1, kind="stable")
                        enough = np.cumsum(size[order], axis=1) >= k
                        last = np.take_along_axis(far, np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]
                        # scores are rounded, hence the margin; cosines are no finer than this near an angle of zero
                        limit = np.where(enough[:, -1], np.minimum(last + 2e-3, np.pi), np.pi)
                        limit[~asked.any(axis=1)] = np.pi
                    wanted = angle - radius <= limit[:, None] + 1e-5
                    wanted[limit >= np.pi / 2 - 1e-5] = True  # a vector without length scores 0 wherever it lies
                    wanted = np.logical_or.reduceat(wanted, first, axis=1)
                rows, blocks = np.nonzero(wanted)
                yield some.iloc[rows].assign(_block=blocks)

    kinds = T.StructType([*queries.schema.fields, T.StructField("_block", T.LongType())])
    by_cell = queries.sparkSession.createDataFrame(pd.DataFrame({"cell": cells["cell"], "_block": number}), "cell long, _block long")
    placed = stored.select("cell", base_id, vec).join(F.broadcast(by_cell), "cell").drop("cell")
    found = nearest_over(queries.mapInPandas(visit, kinds), placed, k, min_score, ("_block",), query_id, base_id, vec)
    return found.select(query_id, base_id, "score", "rank")
