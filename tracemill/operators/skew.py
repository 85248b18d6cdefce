"""Building blocks that keep every task bounded when one key holds most rows.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task. The helpers
here cut a key into buckets (time slices or runs of consecutive positions),
work inside the buckets in parallel, and carry a small summary from one bucket
to the next.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 4_096


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder until the process ends; a cluster session is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        folder = tempfile.mkdtemp(prefix="tracemill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[context.applicationId] = f"file://{folder}"
    return _own[context.applicationId]


def stage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast ``df`` only when it is counted to be small, else leave the choice to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark prunes to ``k`` rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], newest: bool = True) -> DataFrame:
    """One row per key, picked by ``max_by`` so that a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if newest else F.min_by
    row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, out: str = "step"
) -> DataFrame:
    """Dense 1-based position of each row in its key.

    ``bucket`` must grow with ``order`` (a time slice, or an id divided by a
    constant). Rows are numbered inside a bucket and shifted by the row count
    of the earlier buckets.
    """
    marked = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        marked.join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_before") + F.row_number().over(inside))
        .drop("_bucket", "_before")
    )


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
    columns: Sequence[str], out: str = "previous",
) -> DataFrame:
    """Struct of ``columns`` from the row before, per key; null on the first row."""
    return _neighbour(df, keys, order, bucket, columns, out, F.lag, F.max_by)


def next_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
    columns: Sequence[str], out: str = "next",
) -> DataFrame:
    """Struct of ``columns`` from the row after, per key; null on the last row."""
    return _neighbour(df, keys, order, bucket, columns, out, F.lead, F.min_by)


def _neighbour(df, keys, order, bucket, columns, out, shift, edge):
    marked = df.withColumn("_bucket", bucket).withColumn("_cells", F.struct(*columns))
    edges = marked.groupBy(*keys, "_bucket").agg(edge("_cells", F.struct(*order)).alias("_edge"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    carried = edges.select(*keys, "_bucket", shift("_edge").over(across).alias("_carry"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        marked.join(carried, [*keys, "_bucket"])
        .withColumn(out, F.coalesce(shift("_cells").over(inside), F.col("_carry")))
        .drop("_bucket", "_cells", "_carry")
    )


def running(
    df: DataFrame, keys: Sequence[str], step: str,
    columns: dict[str, tuple[Callable, Column]], block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running aggregates (``F.sum``, ``F.max``, ``F.min``) from the first step up to each row.

    Positions are dense, so a block of ``block_rows`` steps is a bounded group.
    Each block starts from the aggregate of the blocks before it.
    """
    marked = df.withColumn("_block", F.floor((F.col(step) - 1) / block_rows))
    names = list(columns)
    for name in names:
        marked = marked.withColumn(f"_in_{name}", columns[name][1])
    parts = marked.groupBy(*keys, "_block").agg(
        *[columns[n][0](f"_in_{n}").alias(f"_part_{n}") for n in names]
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carries = parts.select(
        *keys, "_block", *[columns[n][0](f"_part_{n}").over(before).alias(f"_carry_{n}") for n in names]
    )
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(step)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = marked.join(carries, [*keys, "_block"])
    for name in names:
        aggregate = columns[name][0]
        here = aggregate(f"_in_{name}").over(inside)
        carry = F.col(f"_carry_{name}")
        if aggregate is F.sum:
            total = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif aggregate is F.max:
            total = F.greatest(here, carry)
        else:
            total = F.least(here, carry)
        joined = joined.withColumn(name, total)
    return joined.drop("_block", *[f"_in_{n}" for n in names], *[f"_carry_{n}" for n in names])


def overlapping_blocks(df: DataFrame, step: str, halo: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cut positions into blocks and repeat the last ``halo`` rows at the head of the next block.

    Adds ``_block`` and ``_halo``; frames that look back at most ``halo`` rows
    are then complete inside one block. Drop the ``_halo`` rows afterwards.
    """
    own = F.floor((F.col(step) - 1) / block_rows)
    near_end = (F.col(step) - 1) % block_rows >= block_rows - halo
    return (
        df.withColumn("_own", own)
        .withColumn("_block", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))))
        .withColumn("_halo", F.col("_block") > F.col("_own"))
        .drop("_own")
    )


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores when the source has fewer parts than cores (one small or unsplit file).

    A source with many parts is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(2 * cores)


def fold_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str],
    fold: Callable[[pd.DataFrame, list[tuple[int, int]]], pd.DataFrame], schema: str, pack_rows: int = 4 * BLOCK_ROWS,
) -> DataFrame:
    """``fold(rows, spans)`` on ordered rows, for keys of a bounded size; a span is the rows of one key.

    Keys are packed by hash into groups of about ``pack_rows`` rows, so that
    many small keys cost one Python call. ``df`` is counted: pass a staged table.
    """
    keys, order = list(keys), list(order)
    packs = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // pack_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*keys, *order], kind="stable", ignore_index=True)
        changed = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        return fold(pdf, list(zip(changed, [*changed[1:], len(pdf)])))

    packed = df.withColumn("_pack", F.pmod(F.xxhash64(*keys), F.lit(packs)))
    return packed.groupBy("_pack").applyInPandas(run, schema)


def ordered_fold(
    df: DataFrame, key: str, step: str, columns: Sequence[str], start: list,
    advance: Callable[[list, dict[str, list]], tuple[list, list]],
    out: str, out_type: str, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Fold the rows of each key in step order where each outcome depends on earlier outcomes.

    ``advance(state, rows)`` gets a list per column and returns one output per row and the end state; the
    state is a short JSON list. A key with more rows than a block is folded
    block by block in parallel: every block first assumes the start state, and
    only blocks whose predecessor ended in another state are folded again,
    until no block changes. The result equals the serial fold.
    """
    rows = stage(df.select(key, step, *columns).withColumn("_block", F.floor((F.col(step) - 1) / block_rows).cast("long")))
    key_type = df.schema[key].dataType.simpleString()
    step_type = df.schema[step].dataType.simpleString()
    empty = F.lit(json.dumps(start))
    block = [key, "_block"]

    def folded(pdf: pd.DataFrame, spans: list[tuple[int, int]]) -> list[tuple[list, list]]:
        # Lists are cut in no time; a cut of a table costs more than to fold the few rows that most keys have.
        cells, states = {c: pdf[c].tolist() for c in columns}, pdf["_state"].tolist()
        return [advance(json.loads(states[a]), {c: v[a:b] for c, v in cells.items()}) for a, b in spans]

    def emit(pdf: pd.DataFrame, spans: list[tuple[int, int]]) -> pd.DataFrame:
        values = [value for outputs, _ in folded(pdf, spans) for value in outputs]
        return pd.DataFrame({key: pdf[key], step: pdf[step], out: values})

    def finish(pdf: pd.DataFrame, spans: list[tuple[int, int]]) -> pd.DataFrame:
        ends = [json.dumps(end) for _, end in folded(pdf, spans)]
        heads = pdf.iloc[[a for a, _ in spans]]
        return pd.DataFrame({key: heads[key].values, "_block": heads["_block"].values, "_end": ends})

    emitted = f"{key} {key_type}, {step} {step_type}, {out} {out_type}"
    if (rows.agg(F.max("_block")).first()[0] or 0) == 0:
        return fold_groups(rows.withColumn("_state", empty), [key], [step], emit, emitted)

    starts = stage(rows.select(*block).distinct().withColumn("_state", empty))
    pending = starts
    while not pending.isEmpty():
        ends = fold_groups(rows.join(pending, block), block, [step], finish, f"{key} {key_type}, _block long, _end string")
        handed = ends.select(key, (F.col("_block") + 1).alias("_block"), F.col("_end").alias("_handed"))
        pending = stage(
            starts.join(handed, block).where("_handed <> _state").select(*block, F.col("_handed").alias("_state"))
        )
        revised = pending.withColumnRenamed("_state", "_revised")
        starts = stage(
            starts.join(revised, block, "left").select(*block, F.coalesce("_revised", "_state").alias("_state"))
        )
    return fold_groups(rows.join(starts, block), block, [step], emit, emitted)
