"""Exact duplicates by Patricia tries: equal texts share a terminal node, which remembers the copy that stays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from poolboard.llm.common import FILTER_BITS, SPACES, encoded, key_filter, map_rows, may_be_in, read_documents, stored, whole_row

#: Bytes of labels that a task's trie holds before it spills its largest subtrees.
TRIE_BYTES = 128 << 20
DIGEST = "doc_id bigint, n_code_points bigint, n_bytes bigint, content bigint, sha256 binary"
TERMINAL = "n_bytes bigint, content bigint, string binary, most bigint, keep_id bigint, copies bigint"


def normalised(text: bytes) -> bytes:
    """The text without ASCII white space."""
    return text.translate(None, SPACES)


def content_hash(string: bytes) -> int:
    """64 bits as Spark's signed long."""
    return int.from_bytes(xxhash.xxh3_64_digest(string), "big", signed=True)


def better(a: tuple, b: tuple) -> tuple:
    """Of two terminal values (code points, id, copies) the one that stays, with the copies of both.

    Most code points, then the smallest id; a null id comes last.
    """
    first = a if (-a[0], a[1] is None, a[1] or 0) <= (-b[0], b[1] is None, b[1] or 0) else b
    return first[0], first[1], a[2] + b[2]


def shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Patricia:
    """A radix trie with compressed edges: a node is [label, children by first byte, terminal value or None]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.size = 0

    def insert(self, key: bytes, value: tuple) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, value]
                self.size += len(key) - at
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            cut = shared(label, key[at:at + len(label)])
            node[1][key[at]] = split = [label[:cut], {label[cut]: child}, None]
            child[0] = label[cut:]
            node, at = split, at + cut
        node[2] = value if node[2] is None else better(node[2], value)

    def terminals(self, node: list | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, tuple]]:
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            prefix += node[0]
            if node[2] is not None:
                yield prefix, node[2]
            stack += [(child, prefix) for child in node[1].values()]

    @staticmethod
    def weight(node: list) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node[0])
            stack += node[1].values()
        return total

    def spill(self) -> Iterator[tuple[bytes, tuple]]:
        """Give up the largest subtrees below the root until at most half of the bytes are left."""
        half = self.size // 2
        for weight, first in sorted(((self.weight(c), b) for b, c in self.root[1].items()), reverse=True):
            if self.size <= half:
                break
            self.size -= weight
            yield from self.terminals(self.root[1].pop(first))


def terminal_row(n_bytes: int, content: int, string: bytes, value: tuple) -> tuple:
    return n_bytes, content, string, *value


def digests(docs: DataFrame) -> DataFrame:
    def run(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for rows in slices:
            out = []
            for key, text in rows:
                string = normalised(encoded(text))
                out.append((key, len(text or ""), len(string), content_hash(string), hashlib.sha256(string).digest()))
            yield out

    return map_rows(docs, run, DIGEST)


def owners(docs: DataFrame, repeated: bytes, budget: int = TRIE_BYTES) -> DataFrame:
    """One row for each text of a (length, content hash) partition that may hold copies.

    A task inserts the strings of its rows, each below its partition's key, and hands on the terminals: a string goes
    into the shuffle once per task (more often after a spill), however many copies the task saw. Tries over the
    partitions then merge the terminals of all tasks.
    """
    def local(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        held, trie = np.frombuffer(repeated, dtype=np.uint8), Patricia()

        def rows_of(terminals: Iterator[tuple[bytes, tuple]]) -> list[tuple]:
            return [terminal_row(len(k) - 16, int.from_bytes(k[:8], "big", signed=True), k[16:], v)
                    for k, v in terminals]

        for rows in slices:
            for key, text in rows:
                string = normalised(encoded(text))
                content = content_hash(string)
                at = content % FILTER_BITS
                if held[at >> 3] >> (7 - (at & 7)) & 1:
                    root = content.to_bytes(8, "big", signed=True) + len(string).to_bytes(8, "big")
                    trie.insert(root + string, (len(text or ""), key, 1))
            if trie.size > budget:
                yield rows_of(trie.spill())
        yield rows_of(trie.terminals())

    def merge(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        partition, trie = None, Patricia()

        def rows_of() -> list[tuple]:
            return [(*partition, hashlib.sha256(string).digest(), *value) for string, value in trie.terminals()]

        for rows in slices:
            for n_bytes, content, string, *value in rows:
                if partition != (n_bytes, content):
                    if partition is not None:
                        yield rows_of()
                    partition, trie = (n_bytes, content), Patricia()
                trie.insert(string, tuple(value))
        if partition is not None:
            yield rows_of()

    parts = map_rows(docs, local, TERMINAL)
    dealt = parts.repartition("n_bytes", "content").sortWithinPartitions("n_bytes", "content")
    return map_rows(dealt, merge, "own_bytes bigint, own_content bigint, own_sha256 binary, most bigint, "
                                  "keep_id bigint, copies bigint")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the text without ASCII white space).

    Of equal texts the row with the most code points stays, then the one with the smallest id. First the digests of
    all rows are written; partitions of length and content hash that hold one row need no comparing, and a filter of
    fixed size keeps their texts out of the shuffle. The others are compared byte by byte in tries.

    Null counts as empty, and all empty texts are one group. Of rows that agree in id and length exactly one stays,
    repeated rows included; null ids come last. An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    digest = stored(digests(docs), "digests")
    again = digest.groupBy("n_bytes", "content").count().where("count > 1")
    owned = owners(docs, key_filter(again, "content", hashed=True), budget)
    joined = digest.join(owned, (F.col("n_bytes") == F.col("own_bytes")) & (F.col("sha256") == F.col("own_sha256")),
                         "left")
    alone = F.col("copies").isNull()
    chosen = alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_code_points") == F.col("most")))
    first = F.row_number().over(W.partitionBy("doc_id", "sha256", "chosen").orderBy("n_code_points"))
    return (joined.withColumn("chosen", chosen).withColumn("nth", first)
            .select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("copies", F.lit(1)).cast("bigint").alias("group_size"),
                    (F.col("chosen") & (F.col("nth") == 1)).alias("kept"),
                    F.lower(F.hex("sha256")).alias("text_sha256")))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all columns, which may have any names. Rows that repeat id and text are reduced to one.

    Null counts as empty, and all empty texts are one group; null ids come last; of equal texts with equal ids one row
    stays. An empty table gives no rows. Only rows whose id a filter can't clear of dropped copies are shuffled with
    their text.
    """
    groups = stored(exact_groups(docs, doc_id, text), "copies")
    gone = key_filter(groups.where(~F.col("kept")).select("doc_id"), "doc_id")
    body = F.col("row")[text]
    marked = docs.select(whole_row(docs)).select("row", F.col("row")[doc_id].alias("doc_id")).withColumn(
        "maybe", may_be_in(gone, "doc_id") | F.col("doc_id").isNull())
    bare = F.regexp_replace(F.coalesce(body, F.lit("")), "[ \\t\\n\\x0B\\f\\r]", "")
    rest = marked.where("maybe").withColumn("sha256", F.sha2(bare.cast("binary"), 256))
    kept = groups.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha256"))
    rest = rest.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("sha256") == F.col("kept_sha256")), "left_semi")
    most = W.partitionBy("doc_id", "sha256").orderBy(F.desc(F.length(body)), body)
    rest = rest.withColumn("nth", F.row_number().over(most)).where("nth = 1")
    return marked.where(~F.col("maybe")).select("row").unionByName(rest.select("row")).select("row.*")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(read_documents(spark, sf_dir))


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents
), r AS (
  SELECT doc_id, bare,
         first_value(doc_id) OVER (PARTITION BY bare ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY bare) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM r
"""
