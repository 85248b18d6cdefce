"""Table-level steps shared by several jobs: inserts, upserts, replacement, paging, lookups, set merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.skew import latest_per, top_per


def insert_absent(target: DataFrame | None, new: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Target plus the first new row of every key it lacks: the first write wins."""
    firsts = latest_per(new, key, order, newest=False)
    if target is None:
        return firsts
    return target.unionByName(firsts.join(target.select(*key), list(key), "left_anti"))


def upsert(target: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the last write wins, and a new row wins over a stored one of the same rank."""
    both = target.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_per(both, key, [*order, F.col("_new")]).drop("_new")


def replace_by_key(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of a key in ``new`` replace all its rows in ``target``."""
    return target.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a listing; ``order`` ends in a unique column."""
    return df.orderBy(*order).offset(offset).limit(limit)


def trail(df: DataFrame, key: str, value, order: Sequence[Column]) -> DataFrame:
    """Rows of one key in order."""
    return df.where(F.col(key) == value).orderBy(*order)


def by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a table of ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def merge_first(parts: Sequence[DataFrame], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of the parts with the first row per key, parts in the given order."""
    merged = None
    for number, part in enumerate(parts):
        marked = part.withColumn("_part", F.lit(number))
        merged = marked if merged is None else merged.unionByName(marked, allowMissingColumns=True)
    return latest_per(merged, key, [F.col("_part"), *[F.col(o) for o in order]], newest=False).drop("_part")


def merge_old_first(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows and the new rows whose key is not there yet."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def stratified(df: DataFrame, column: str, size: int, row_id: Column, seed: int) -> DataFrame:
    """``size`` rows per stratum in the order of a seeded hash, with the position in the shuffled sample."""
    shuffle = F.md5(F.concat_ws("|", row_id.cast("string"), F.lit(str(seed))))
    return top_per(df.withColumn("shuffle", shuffle), [column], [F.col("shuffle"), row_id], size, "rank").drop("rank")
