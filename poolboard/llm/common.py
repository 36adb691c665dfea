"""What the text operators share: reading documents, written tables, row batches and stable cuts by document id."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolboard.session import ensure_shared_dir, fresh_path

#: ASCII white space, the only white space that separates words here.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch that are turned into Python objects at once, by its mean row.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch between Spark and a Python worker; by default it holds up to 10,000 rows, whole texts with them.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns in one, ``row``: names used beside it can't clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; a local session without that setting gets a folder."""
    return fresh_path(ensure_shared_dir(spark), f"llm-{name}")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound the Arrow batches of the jobs inside to ``BATCH_BYTES``, unless the session has a bound of its own.

    An executor and its workers each hold such batches, beside its heap. Where one starts changes no result.
    """
    own = spark.conf.get(BATCH_SETTING, None)
    if own is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(BATCH_SETTING)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: it is computed once and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share_of(doc_id: Column | str, parts: int) -> Column:
    """``crc32`` of the id as text modulo ``parts``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def crc32_sql(number: str) -> str:
    """DuckDB SQL for the ``crc32`` of a number as text, bit by bit with the reversed polynomial; null as the empty text."""
    steps = f"list_transform(string_split({number}::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, {', '.join(['-1'] * 8)}])"
    crc = (f"list_reduce(list_concat([{0xFFFFFFFF}::BIGINT], flatten({steps})), lambda a, x: "
           f"CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, {0xEDB88320} * (a & 1)) END)")
    return f"CASE WHEN {number} IS NULL THEN 0 ELSE xor({crc}, {0xFFFFFFFF}) END"


def encoded(text: str | None) -> bytes:
    """UTF-8 of a text, nothing for null."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def batch_slices(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches of about ``size`` bytes (``SLICE_BYTES``), without copying."""
    size = size or SLICE_BYTES
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        give_back()


def filled_slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """``batch_slices`` with small batches put together, so that a slice doesn't shrink with the batches."""
    held = []
    for part in batch_slices(batches, size):
        held.append(part)
        if 4 * sum(p.nbytes for p in held) >= 3 * size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def lower_words(texts: pa.Array) -> pa.ListArray:
    """Words of texts in lower case (A-Z alone); the ends of a text may give empty words.

    The texts are copied first: Arrow's case functions misread arrays that are part of a batch.
    """
    whole = texts.take(pa.array(np.arange(len(texts))))
    return pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(whole.cast(pa.large_string()), "")))


def map_rows(df: DataFrame, function: Callable[[Iterator[list[tuple]]], Iterable[list[tuple]]],
             schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over lists of row tuples: a bounded part of a batch is held as Python objects."""
    arrow = arrow_schema(schema)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for part in batch_slices(batches):
            yield list(zip(*(c.to_pylist() for c in part.columns), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in function(slices(batches)):
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


#: Bits of a filter and of one of its pages; a filter is 2 MB whatever the data.
FILTER_BITS, PAGE_BITS = 1 << 24, 1 << 16


def key_filter(keys: DataFrame, key: str, hashed: bool = False) -> bytes:
    """A bit for each hash of the non-null ``key`` column (``hashed``: it is a hash itself), folded to a fixed size: what is not in it is not in ``keys``.

    Tasks set bits in pages of 8 kB, pages are merged by number, and the driver gets 256 pages at most.
    """
    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, dtype=bool)
        for batch in batches:
            bits[batch.column(0).to_numpy(zero_copy_only=False) % FILTER_BITS] = True
        found = [(n, np.packbits(page).tobytes()) for n, page in enumerate(bits.reshape(-1, PAGE_BITS)) if page.any()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()),
                                              pa.array([p for _, p in found], pa.binary())], ["page", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        bits = np.zeros(PAGE_BITS // 8, dtype=np.uint8)
        for page in table.column("bits"):
            bits |= np.frombuffer(page.as_py(), dtype=np.uint8)
        return pa.table({"page": table.column("page").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    hashes = keys.where(F.col(key).isNotNull()).select(F.col(key) if hashed else F.xxhash64(key))
    merged = hashes.mapInArrow(pages, "page bigint, bits binary").groupBy("page").applyInArrow(
        merge, "page bigint, bits binary")
    out = bytearray(FILTER_BITS // 8)
    for page, bits in merged.collect():
        out[page * PAGE_BITS // 8:(page + 1) * PAGE_BITS // 8] = bits
    return bytes(out)


def in_filter(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    at = hashes % FILTER_BITS
    return np.frombuffer(bits, dtype=np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1


def may_be_in(bits: bytes, key: str) -> Column:
    """Whether the filter may hold the hash of ``key``; never true for null."""
    @F.arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        return pa.array(in_filter(bits, hashes.to_numpy(zero_copy_only=False)))

    return F.col(key).isNotNull() & test(F.xxhash64(key))


def range_cuts(docs: DataFrame, doc_id: str, parts: int) -> list[float]:
    """About ``parts`` even cuts of the ids, for work in document order: where they fall changes no result.

    Reads the id column alone; the sketch behind the quantiles has a fixed size.
    """
    if parts < 2:
        return []
    return sorted(set(docs.approxQuantile(doc_id, [n / parts for n in range(1, parts)], 0.2 / parts)))


def range_of(cuts: list[float], doc_id: str) -> Column:
    """The range of an id, in ascending order; a null id has the last one."""
    @F.arrow_udf("int")
    def find(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, ids.to_numpy(zero_copy_only=False), side="left").astype("int32"))

    return F.when(F.col(doc_id).isNull(), F.lit(len(cuts) + 1)).otherwise(find(F.coalesce(doc_id, F.lit(0))))
