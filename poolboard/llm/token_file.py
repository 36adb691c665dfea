"""Token ids of documents in coded files, in ascending document order, and back."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from poolboard.llm import range_coder
from poolboard.llm.common import arrow_schema, map_rows, range_cuts, read_documents, shared_path
from poolboard.llm.tokens import tokenizer_path, word_encoder

#: Ids of a segment; a document always lies in one segment, so a longer document makes a longer segment.
SEGMENT = 1024 * range_coder.BLOCK
FILES = "part int, start bigint, n_ids bigint, ids binary, doc_ids array<bigint>, lengths array<bigint>"
FILE_FIELDS = "start bigint, n_ids bigint, ids binary, doc_ids array<bigint>, lengths array<bigint>, part int"
READ = "doc_id bigint, part int, start bigint, n_tokens bigint, ids_crc32 bigint"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = 1, doc_id: str = "doc_id",
                      text: str = "text", parts: int | None = None) -> None:
    """Write the ids of every document, ``end`` appended, in ascending order of document id, null ids last.

    ``path`` gets a folder ``part=N`` for each range of ids, in order; a file row is a segment: its first id's place in
    the part, the coded ids and the ids and lengths of its documents. The rows are written by Spark's own writer, so
    that a repeated or lost task leaves no half-written file and any store works. Ids must be below 65,536. Repeated
    rows each keep their place; rows with equal ids are in the order of their token ids.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts = parts or max(docs.rdd.getNumPartitions(), 1)
    cuts = range_cuts(docs, "doc_id", parts)

    def tokens(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        encoder = word_encoder(tokenizer)
        for rows in slices:
            out = []
            for (key, _), ids in zip(rows, encoder.encode([t for _, t in rows]), strict=True):
                if len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("ids of 65,536 and above don't fit this format")
                part = len(cuts) if key is None else bisect.bisect_left(cuts, key)
                out.append((part, key, ids.astype("<u2").tobytes() + end.to_bytes(2, "little")))
            yield out

    schema = arrow_schema(FILES)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, held, names = None, 0, [], []

        def segment() -> Iterator[pa.RecordBatch]:
            nonlocal start, held, names
            if held:
                ids = np.frombuffer(b"".join(held), "<u2")
                yield pa.RecordBatch.from_pylist([{
                    "part": part, "start": start, "n_ids": len(ids), "ids": range_coder.encode_segment(ids),
                    "doc_ids": names, "lengths": [len(h) // 2 for h in held]}], schema=schema)
                start, held, names = start + len(ids), [], []

        size = 0
        for batch in batches:
            for p, key, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part or size >= SEGMENT:
                    yield from segment()
                    size = 0
                if p != part:
                    part, start = p, 0
                held.append(raw)
                names.append(key)
                size += len(raw) // 2
        yield from segment()

    ids = map_rows(docs, tokens, "part int, doc_id bigint, ids binary")
    dealt = ids.repartitionById(len(cuts) + 2, "part").sortWithinPartitions("part", F.asc_nulls_last("doc_id"), "ids")
    dealt.mapInArrow(segments, FILES).write.partitionBy("part").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Decode files of ``write_token_files``: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    Each segment is decoded alone, every block against its checksum; a wrong one fails the job. ``start`` adds up the
    sizes of the parts, one row each.
    """
    files = spark.read.schema(FILE_FIELDS).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("size"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.select(F.col("part").alias("of_part"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))

    schema = arrow_schema(READ)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, start, coded, names, lengths = (c[row].as_py() for c in batch.columns)
                ids = range_coder.decode_segment(coded)
                ends = np.cumsum(np.array(lengths, dtype=np.int64))
                starts = ends - lengths
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array([part] * len(names), pa.int32()), pa.array(starts + start),
                     pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], schema=schema)

    read = files.select("part", "start", "ids", "doc_ids", "lengths").mapInArrow(documents, READ)
    return (read.join(first, F.col("part") == F.col("of_part"), "left")
            .select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write_token_files(read_documents(spark, sf_dir), path, tokenizer_path("word_bpe_49k.json"))
    return read_token_files(spark, path)
