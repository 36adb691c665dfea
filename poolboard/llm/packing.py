"""Pack token pieces into fixed-size training sequences: bounded-space online best-fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolboard.llm.common import map_rows, stored
from poolboard.llm.tokens import tokenizer_path, word_encoder

CAPACITY = 2048
#: Bins a packer keeps open.
OPEN_BINS = 256
#: Tasks whose leftover bins are packed together in the second pass.
FAN_IN = 64
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = f"{PIECES}, bin bigint, offset bigint, fill bigint, closed boolean, task bigint"


class BestFit:
    """Places items in the open bin that they fill best.

    ``levels`` holds the open bins by free space and ``free`` has a bit for each free space that occurs: the lowest bit
    at or above an item's length names the best bin. If all bins are open and none fits, the fullest closes.
    """

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.free, self.levels, self.open, self.made = 0, {}, 0, 0

    def put(self, length: int) -> tuple[int, int, list[int]]:
        """The bin, the offset in it and the bins that closed."""
        closed = []
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self.take(space)
        else:
            if self.open == self.open_bins:
                closed.append(self.take((self.free & -self.free).bit_length() - 1))
                self.open -= 1
            number, space = self.made, self.capacity
            self.made += 1
            self.open += 1
        left = space - length
        if left:
            self.levels.setdefault(left, []).append(number)
            self.free |= 1 << left
        else:
            closed.append(number)
            self.open -= 1
        return number, self.capacity - space, closed

    def take(self, space: int) -> int:
        bins = self.levels[space]
        number = bins.pop()
        if not bins:
            del self.levels[space]
            self.free &= ~(1 << space)
        return number


def pieces(docs: DataFrame, path: str, capacity: int, separator: int, doc_id: str, text: str, packer) -> DataFrame:
    """Tokenise rows and place their pieces task by task."""

    def run(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        encoder, end = word_encoder(path), separator.to_bytes(4, "little")
        pack = packer()
        for rows in slices:
            out = []
            for (key, _), ids in zip(rows, encoder.encode([t for _, t in rows]), strict=True):
                ids = ids.tobytes() + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((key, n, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pack(out)
        yield pack(None)

    return map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, PLACED)


def placing(capacity: int, open_bins: int):
    """A function from pieces to placed pieces; a bin's pieces leave when it closes, at the end all that are left."""
    fit, held = BestFit(capacity, open_bins), {}
    task = TaskContext.get().partitionId()

    def leave(number: int, done: bool) -> list[tuple]:
        rows = held.pop(number)
        fill = rows[-1][-1] + rows[-1][3]
        return [(*r[:5], number, r[5], fill, done, task) for r in rows]

    def pack(rows: list[tuple] | None) -> list[tuple]:
        if rows is None:
            return [r for number in sorted(held) for r in leave(number, False)]
        out = []
        for row in rows:
            number, offset, closed = fit.put(row[3])
            held.setdefault(number, []).append((*row, offset))
            for c in closed:
                out += leave(c, True)
        return out

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
                   separator: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sequences of at most ``capacity`` tokens, a row for each piece of a document.

    A document is its ids and then ``separator``; only a document longer than a sequence is cut. Each task packs its own
    rows and keeps ``open_bins`` bins open. Bins that are still open when a task ends are packed a second time, as
    whole items, ``FAN_IN`` tasks together; that pass sees at most ``open_bins`` rows per task. The placed pieces are
    written to the shared folder first, so that both passes and a repeated task see the same places.

    Null or empty text: one piece that holds the separator alone. Repeated rows and null ids: packed like any row, each
    for itself. An empty table gives no rows. Other columns are ignored.
    """
    placed = stored(pieces(docs, tokenizer, capacity, separator, doc_id, text,
                           lambda: placing(capacity, open_bins)), "pieces")
    left = placed.where(~F.col("closed")).groupBy("task", "bin").agg(F.first("fill").alias("fill"))

    def merge(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        fit, group = None, None
        for rows in slices:
            out = []
            for task, number, fill in rows:
                if task // FAN_IN != group:
                    group, fit = task // FAN_IN, BestFit(capacity, open_bins)
                into, offset, _ = fit.put(fill)
                out.append((task, number, group, into, offset))
            yield out

    groups = (left.repartition(F.floor(F.col("task") / FAN_IN))
              .sortWithinPartitions(F.floor(F.col("task") / FAN_IN), F.desc("fill"), "task", "bin"))
    moved = map_rows(groups.select("task", "bin", "fill"), merge,
                     "task bigint, bin bigint, into_group bigint, into bigint, shift bigint")
    # closed bins have even numbers, merged ones odd numbers; the low 32 bits count inside a task or group
    own = F.shiftleft(F.col("task") * 2, 32) + F.col("bin")
    merged = F.shiftleft(F.col("into_group") * 2 + 1, 32) + F.col("into")
    done = placed.where("closed").withColumn("sequence_id", own).withColumn("shift", F.lit(0).cast("bigint"))
    again = (placed.where(~F.col("closed")).join(moved, ["task", "bin"])
             .withColumn("sequence_id", merged))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
               (F.col("offset") + F.col("shift")).alias("offset")]
    return done.select(columns).unionByName(again.select(columns))


def op8_pack(spark, sf_dir: str) -> DataFrame:
    from poolboard.llm.common import read_documents

    return pack_documents(read_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
