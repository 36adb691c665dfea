"""Mix sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from poolboard.llm.common import read_documents, stored, whole_row

#: No source gives more than this many times its words.
MOST = 3
#: Ranges of sampling keys in one doubling of the key; bounds what one task sorts to a few thousandths of a source.
RANGES = 256
#: Sources whose plan (a few numbers each) is broadcast; with more, it is joined like any table.
BROADCAST_SOURCES = 10_000
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """Share of small letters and spaces among the characters, 0.05 at least: plain prose weighs most."""
    plain = F.length(text) - F.length(F.translate(text, "abcdefghijklmnopqrstuvwxyz ", ""))
    return F.greatest(F.lit(0.05), F.coalesce(plain / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)))


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from the id and the text, the same in every run."""
    named = F.concat_ws("/", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")),
                        F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digits = F.conv(F.substring(F.md5(named.cast("binary")), 1, 12), 16, 10).cast("double")
    return (digits + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """Words wanted of each source, from rows (source, source_size): a row per source.

    Sources in code-point order, null last, weigh ``weights`` over and over and share all words. A target stops at
    ``most`` times its source's size; what is above goes to the others by weight until none is above. The sources at
    their bound are those with the smallest size per weight, so one pass over the sources in that order finds them; the level
    of the first one that isn't (the highest of theirs) holds for all the others.
    """
    order = W.orderBy(F.asc_nulls_last(F.col("source").cast("binary")))
    cycle = F.array(*[F.lit(w) for w in weights])
    weight = F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_ratio = W.orderBy(F.col("bound") / F.col("weight"), F.asc_nulls_last(F.col("source").cast("binary")))
    sofar = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    level = ((total - F.coalesce(F.sum("bound").over(sofar), F.lit(0))) / F.sum("weight").over(onward))
    return (sizes.withColumn("weight", weight).withColumn("bound", F.col("source_size") * most)
            .withColumn("level", level)
            .withColumn("full", F.col("bound") <= F.col("weight") * F.col("level"))
            .withColumn("rest_level", F.max(F.when(~F.col("full"), F.col("level"))).over(W.partitionBy()))
            .select("source", "source_size",
                    F.when(F.col("full"), F.col("bound").cast("double"))
                    .otherwise(F.col("weight") * F.col("rest_level")).alias("target")))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weight: Column | str | None = None, seed: int = 7, most: int = MOST, ranges: int = RANGES) -> DataFrame:
    """What a mix of all sources takes of each document: doc_id, size, source_size, target, taken, sampling_key.

    Each source is taken whole as often as its target holds it (complete epochs). What is left of the target is
    filled in the order of the keys -ln(u) / weight, smallest first: weighted sampling without replacement. The document
    in which the target ends gives only the words still wanted, so a source's taken words are its target without the
    fraction. Keys come from hashes of id and text: reruns agree.

    The order is not sorted as a whole. Words are summed by source and key range; only the range in which the budget
    ends is sorted, so no task holds a source. Null text: no words, never taken. Null sources are one source. Repeated
    rows are rows of their own; rows with equal keys are ordered by id and size. An empty table gives no rows.
    """
    named = renamed(docs, doc_id, text, source, weight)
    rows = stored(with_keys(named, seed, ranges).drop("text", "weight"), "mixing")
    return taken_of(rows, range_plan(rows, most)).select(
        "doc_id", "size", "source_size", "target", "taken", "sampling_key")


def renamed(docs: DataFrame, doc_id: str, text: str, source: str, weight: Column | str | None) -> DataFrame:
    weight = quality_weight(F.col(text)) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"),
                       weight.alias("weight"))


def with_keys(rows: DataFrame, seed: int, ranges: int) -> DataFrame:
    """Add size, sampling_key and range."""
    key = -F.ln(uniform(F.col("doc_id"), F.col("text"), seed)) / F.col("weight")
    return (rows.withColumn("size", word_count(F.col("text"))).withColumn("sampling_key", key)
            .withColumn("range", F.floor(F.log2("sampling_key") * ranges)))


def range_plan(rows: DataFrame, most: int) -> DataFrame:
    """What becomes of each key range of each source; ``whole``: 1 taken, 0 left, null: the budget ends in it."""
    by_range = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    by_range = by_range.withColumn("source_size", F.sum("words").over(W.partitionBy("source")))
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most=most)
    return (by_range.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
            .join(wanted.select(F.col("source").alias("of_source"), "target"),
                  F.col("source").eqNullSafe(F.col("of_source")))
            .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                        .otherwise(0).cast("bigint"))
            .withColumn("budget", F.floor("target") - F.col("epochs") * F.col("source_size"))
            .withColumn("whole", F.when(F.col("before") + F.col("words") <= F.col("budget"), 1)
                        .when(F.col("before") >= F.col("budget"), 0))
            .select(F.col("source").alias("of_source"), F.col("range").alias("of_range"), "source_size", "target",
                    "epochs", "budget", "before", "whole"))


def taken_of(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add the plan's columns, ``extra`` (words of the last, partial epoch) and ``taken``."""
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("range") == F.col("of_range")))
    inside = (W.partitionBy("source", "range").orderBy("sampling_key", F.asc_nulls_last("doc_id"), "size")
              .rowsBetween(W.unboundedPreceding, -1))
    sure = placed.where(F.col("whole").isNotNull()).withColumn("extra", F.col("whole") * F.col("size"))
    split = (placed.where(F.col("whole").isNull())
             .withColumn("left", F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0)))
             .withColumn("extra", F.greatest(F.lit(0), F.least("size", "left"))).drop("left"))
    return sure.unionByName(split).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("extra")).cast("bigint"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          weight: Column | str | None = None, seed: int = 7, most: int = MOST, ranges: int = RANGES) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all columns.

    The copy in which a source's target ends has the words still wanted, joined by single spaces (at most one row per
    source; its other columns are as they were). Documents that aren't taken, those without words among them, are
    left out. Columns may have any names. Texts aren't shuffled but for the rows of the one key range per source in which its budget ends.
    """
    named = renamed(docs, doc_id, text, source, weight)
    rows = stored(with_keys(named, seed, ranges).drop("text", "weight"), "mixing")
    plan = stored(range_plan(rows, most), "mixing-plan")
    by_source = plan.groupBy(F.col("of_source").alias("plan_source")).agg(
        F.first("epochs").alias("epochs"), F.max(F.when(F.col("whole") == 1, F.col("of_range"))).alias("upto"),
        F.max(F.when(F.col("whole").isNull(), F.col("of_range"))).alias("cut"))
    if by_source.count() <= BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    weight_of = quality_weight(F.col(text)) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    key = -F.ln(uniform(F.col(doc_id), F.col(text), seed)) / weight_of
    body = F.col("row")[text]
    found = (docs.select(whole_row(docs), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), key.alias("key"),
                         word_count(F.col(text)).alias("size"))
             .withColumn("range", F.floor(F.log2("key") * ranges))
             .join(by_source, F.col("source").eqNullSafe(F.col("plan_source"))).where("size > 0"))
    inside = F.coalesce(F.col("range") == F.col("cut"), F.lit(False))
    easy = found.where(~inside).withColumn(
        "extra", F.when(F.col("range") <= F.col("upto"), F.col("size")).otherwise(0).cast("bigint"))
    same = ["source", "sampling_key", "doc_id", "size"]
    split = taken_of(rows, plan.where("whole IS NULL")).withColumn(
        "nth", F.row_number().over(W.partitionBy(same).orderBy("extra"))).select(
        *[F.col(c).alias(f"{c}_of") for c in same], F.col("nth").alias("nth_of"), "extra")
    hard = found.where(inside).withColumn(
        "nth", F.row_number().over(W.partitionBy("source", "key", "doc_id", "size").orderBy(body)))
    hard = hard.join(split, F.col("source").eqNullSafe(F.col("source_of")) & (F.col("key") == F.col("sampling_key_of"))
                     & F.col("doc_id").eqNullSafe(F.col("doc_id_of")) & (F.col("size") == F.col("size_of"))
                     & (F.col("nth") == F.col("nth_of")))
    wanted = ["row", "size", "epochs", "extra"]
    copies = F.col("epochs") + (F.col("extra") > 0).cast("bigint")
    repeated = (easy.select(wanted).unionByName(hard.select(wanted)).withColumn("copies", copies).where("copies > 0")
                .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))))
    words = F.split(F.trim(F.regexp_replace(body, SPACE_RUN, " ")), " ")
    part = (F.col("copy") > F.col("epochs")) & (F.col("extra") < F.col("size"))
    cut = F.when(part, F.concat_ws(" ", F.slice(words, 1, F.greatest(F.lit(1), F.col("extra")).cast("int")))).otherwise(body)
    return repeated.select(*[(cut if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def op5_mix(spark, sf_dir: str) -> DataFrame:
    return mix(read_documents(spark, sf_dir)).drop("sampling_key")


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || md5('7/' || coalesce(doc_id::VARCHAR, '') || '/' || md5(text))[1:12])::BIGINT::DOUBLE + 0.5)
             / 281474976710656.0)
         / greatest(0.05, CASE WHEN length(text) = 0 THEN 0.0 ELSE
             (length(text) - length(regexp_replace(text, '[a-z ]', '', 'g')))::DOUBLE / length(text) END) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), rounds AS (
  -- one round of resharing after another: the sources at their bound leave the rest to the others
  SELECT 0 AS round, source, source_size, weight, false AS capped,
         weight * ((sum(source_size) OVER ())::DOUBLE / sum(weight) OVER ()) AS target
  FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, capped_now,
         CASE WHEN capped_now THEN (3 * source_size)::DOUBLE ELSE weight
           * ((total - coalesce(sum(CASE WHEN capped_now THEN 3 * source_size END) OVER (), 0))::DOUBLE
              / sum(CASE WHEN capped_now THEN 0 ELSE weight END) OVER ()) END
  FROM (SELECT *, capped OR target > 3 * source_size AS capped_now, sum(source_size) OVER () AS total,
               bool_or(NOT capped AND target > 3 * source_size) OVER () AS more FROM rounds)
  WHERE more
), t AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs
  FROM rounds WHERE round = (SELECT max(round) FROM rounds)
), p AS (
  SELECT doc_id, size, source_size, target, epochs, floor(target)::BIGINT - epochs * source_size
         - coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, left_over)))::BIGINT AS taken
FROM p
"""
