"""What the operators of this package share: the shared folder, tables written to it, text slots."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder until the process ends; a cluster session is an error,
    because no folder of one machine would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[context.applicationId] = f"file://{folder}"
    return _own[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: later jobs neither repeat its work nor depend on executors."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts_of(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """Columns ``doc_id`` and ``text`` alone, and the carried columns in a struct ``payload``, so that no name can clash."""
    columns = [docs[id_col].alias("doc_id"), docs[text_col].alias("text")]
    if carry:
        columns.append(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)]).alias("payload"))
    return docs.select(*columns)


def uncarried(frame: DataFrame, carry: list[str]) -> DataFrame:
    """``payload`` as columns under their own names again."""
    rest = [frame[c] for c in frame.columns if c != "payload"]
    return frame.select(*rest, *[F.col(f"payload.c{i}").alias(c) for i, c in enumerate(carry)])


def slotted(texts: DataFrame, count: int) -> DataFrame:
    """Deal texts to four slots a partition by a hash of id and text, all of a slot in one partition.

    The content of a slot depends on the rows alone, so a task that runs again after a lost executor sees the same slot.
    """
    slot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(4 * count)).cast("int")
    return texts.withColumn("slot", slot).repartition(count, "slot")


def drawn(frame: DataFrame, column: str, limit: int, id_col: str = "doc_id") -> DataFrame:
    """About ``limit`` rows of each value of ``column`` (all where there are fewer), chosen by a hash of the id."""
    held = {r[column]: r["n"] for r in frame.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).collect()}
    if not held:
        return frame.limit(0)
    share = F.create_map(*[F.lit(x) for value, n in held.items() for x in (value, min(1_000_000, 1_000_000 * limit // n + 1))])
    return frame.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share[F.col(column)])


def held_out(divisor: int, remainder: int, column: str = "doc_id"):
    """Whether crc32 of the id as text has the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % divisor == remainder, F.lit(False))
