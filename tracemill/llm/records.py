"""Token ids as length-delimited binary records, with a separate offset index for reads in any order.

File format, all numbers little-endian. A data file is a row of frames; a frame is the payload's length (8 bytes), the
masked CRC-32C of those 8 bytes (4), the payload, and the masked CRC-32C of the payload (4). A payload is the width of
an id in bytes (1), whether the document has an id (1), that id (8), and the token ids. An index file holds one 8-byte
offset per frame and, last, the size of the data file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import common, tokens
from tracemill.llm.checksum import crc32c, masked

END_ID = 1
HEAD = "<BBq"
FILE = "part int, path string, records long, ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Bytes of frames read at once; a larger frame is still read whole.
READ_BYTES = 4 << 20


def frames(payloads: list[bytes]) -> list[bytes]:
    """Each payload framed."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    head, body = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [b"".join((n, a.tobytes(), p, b.tobytes())) for n, a, p, b in zip(lengths, head, payloads, body, strict=True)]


def unframed(data: bytes, offsets: np.ndarray, path: str) -> list[bytes]:
    """Payloads of the frames at ``offsets`` (the last one is the end); an altered byte is an error."""
    parts = [(data[a:a + 8], data[a + 8:a + 12], data[a + 12:b - 4], data[b - 4:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    sizes = [struct.unpack("<Q", n)[0] for n, _, _, _ in parts]
    head = masked(crc32c([n for n, _, _, _ in parts])).astype("<u4").tobytes()
    body = masked(crc32c([p for _, _, p, _ in parts])).astype("<u4").tobytes()
    if head != b"".join(h for _, h, _, _ in parts) or body != b"".join(c for _, _, _, c in parts) or sizes != [len(p) for _, _, p, _ in parts]:
        raise ValueError(f"a frame of {path} does not match its checksums")
    return [p for _, _, p, _ in parts]


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    width, known, doc_id = struct.unpack_from(HEAD, payload)
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(HEAD))


def _write(folder: str, tokenizer_path: str, end_id: int):
    """One data and one index file per task. Names are new for each attempt; only those of finished tasks are reported."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.tokenizer(tokenizer_path)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], encoder.dtype).tobytes()
        store, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/part-{part:06d}-{uuid.uuid4().hex}"
        store.create_dir(base, recursive=True)
        at = count = ids = 0
        with store.open_output_stream(path + ".records") as data, store.open_output_stream(path + ".index") as index:
            for batch in batches:
                names, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
                for a, b in tokens.blocks(texts):
                    found = [x + end for x in encoder.encode(texts[a:b])]
                    framed = frames([struct.pack(HEAD, encoder.dtype.itemsize, n is not None, n or 0) + x for n, x in zip(names[a:b], found, strict=True)])
                    sizes = np.array([len(x) for x in framed], np.int64)
                    index.write((at + np.cumsum(sizes) - sizes).astype("<u8").tobytes())
                    data.write(b"".join(framed))
                    at += int(sizes.sum())
                    count += b - a
                    ids += sum(map(len, found)) // encoder.dtype.itemsize
            index.write(struct.pack("<Q", at))
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "path": [f"{folder}/{path.rsplit('/', 1)[1]}"],
            "records": pa.array([count], pa.int64()), "ids": pa.array([ids], pa.int64()),
        })

    return write


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents in ascending id order to record files in ``folder`` and return the files.

    Rows: part (order of the files), path (without its ending), records, ids (tokens in the file). Ids are those of the
    tokenizer file without special tokens, and ``end_id`` after each document. A null or empty text has the end id
    alone; null document ids come first; equal ids follow each other by text. An empty table gives files without
    records or none. ``folder`` is one that all executors share, local or remote.
    """
    texts = common.texts_of(docs, id_col, text_col)
    ordered = texts.repartitionByRange(common.partitions(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return common.stored(ordered.mapInArrow(_write(folder, tokenizer_path, end_id), FILE), "record-files")


def _frames_of(path: str, numbers: np.ndarray | None = None) -> Iterator[list[bytes]]:
    """Payloads of all records of a file in order, or of those with the given numbers."""
    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_stream(base + ".index") as file:
        index = np.frombuffer(file.read(), "<u8").astype(np.int64)
    with store.open_input_file(base + ".records") as file:
        if numbers is not None:
            for n in numbers:
                yield unframed(file.read_at(int(index[n + 1] - index[n]), int(index[n])), index[n:n + 2] - index[n], path)
            return
        at = 0
        while at < len(index) - 1:
            stop = max(at + 1, int(np.searchsorted(index, index[at] + READ_BYTES, side="right")) - 1)
            yield unframed(file.read_at(int(index[stop] - index[at]), int(index[at])), index[at:stop + 1] - index[at], path)
            at = stop


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            at = row["base"]
            for payloads in _frames_of(row["path"]):
                rows = []
                for doc_id, ids in map(parsed, payloads):
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_summaries(files: DataFrame) -> DataFrame:
    """Per record, in file order: doc_id, start (ids in all records before it), n_tokens, ids_crc32 over 4-byte ids.

    The driver adds up one number per file, no more.
    """
    spark, base, rows = files.sparkSession, 0, []
    for row in files.orderBy("part").collect():
        if row["records"]:
            rows.append((len(rows), row["path"], base))
        base += row["ids"]
    listed = spark.createDataFrame(rows, "part int, path string, base long")
    return listed.repartitionById(max(1, len(rows)), listed["part"]).mapInArrow(_summaries, READ)


def read_shuffled(files: DataFrame, seed: int = 0, tasks: int | None = None) -> DataFrame:
    """All records (doc_id, ids) in a pseudo-random order, each fetched by its offset: only record numbers are shuffled."""
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, number in zip(batch["path"].to_pylist(), batch["number"].to_pylist(), strict=True):
                doc_id, ids = parsed(next(_frames_of(path, np.array([number])))[0])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), "ids": pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))})

    numbers = files.where("records > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1)).alias("number"))
    place = numbers.withColumn("place", F.xxhash64("path", "number", F.lit(seed)))
    tasks = tasks or common.partitions(files.sparkSession)
    return place.repartitionByRange(tasks, "place").sortWithinPartitions("place").mapInArrow(fetch, "doc_id long, ids array<int>")


def op4_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_records(common.documents(spark, sf_dir), common.new_path(spark, "records"), tokens.default_path())
    return read_summaries(files)
