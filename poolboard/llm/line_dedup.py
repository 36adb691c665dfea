"""Line dedup: lines that several documents repeat stay in one of them.

Normalised lines are exploded with their position and hashed; documents are counted per hash; lines over the threshold
go, and what is left is put together again by position. Built-in functions only: no Python runs on the executors.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, read_documents, stored, whole_row

MIN_DOCS, MIN_CHARS = 3, 20
#: A line key with more than this share of the places of repeated lines is joined by broadcast: there are at most 1 / share.
HOT_SHARE = 1e-4


def _hashes(value: str, names: tuple[str, str]) -> list[Column]:
    """Two 64-bit hashes with different seeds, as one of 128 bits."""
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(1), value).alias(names[1])]


def _bodies(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The whole row in one column, so its column names can't clash with those used here, and its key."""
    body = F.coalesce(F.col("row")[text], F.lit(""))
    return docs.select(whole_row(docs)).select(
        "row", F.col("row")[doc_id].alias("id"), body.alias("body")).select(
        "row", "id", *_hashes("body", ("text_a", "text_b")))


def line_places(docs: DataFrame, min_chars: int = MIN_CHARS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each line whose key has ``min_chars`` code points: document, hash of its text, position, hash of the key.

    A key is the line without ASCII white space at its ends, A-Z in lower case.
    """
    keys = F.transform(F.split(F.translate(F.coalesce(F.col("row")[text], F.lit("")), ascii_uppercase, ascii_lowercase),
                               "\n", -1), lambda line: F.btrim(line, F.lit(SPACES.decode())))
    lines = _bodies(docs, text, doc_id).select("id", "text_a", "text_b", F.posexplode(keys).alias("at", "key"))
    return lines.where(F.length("key") >= min_chars).select(
        "id", "text_a", "text_b", "at", *_hashes("key", ("key_a", "key_b")))


def repeated_lines(places: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Hashes of the keys that ``min_docs`` documents hold: documents, places, and the largest id among them.

    Rows that share an id are one document; a null id is one as well, and the smallest.
    """
    return places.groupBy("key_a", "key_b").agg(
        F.count_distinct(F.struct("id")).alias("n_docs"), F.count("*").alias("n_places"),
        F.max("id").alias("last")).where(F.col("n_docs") >= min_docs)


def dropped_places(places: DataFrame, repeated: DataFrame) -> DataFrame:
    """Places of repeated lines outside the last document that holds them, per text: (id, text_a, text_b, dropped).

    Keys of a large share of all places are few and go to the places by broadcast; the others have bounded groups.
    """
    total = repeated.agg(F.sum("n_places")).first()[0] or 0
    often = F.col("n_places") > total * HOT_SHARE
    hot = repeated.where(often).select("key_a", "key_b", F.struct("last").alias("hot"))
    rare = repeated.where(~often).select(F.col("key_a").alias("to_a"), F.col("key_b").alias("to_b"), F.struct("last").alias("rare"))
    met = places.join(F.broadcast(hot), ["key_a", "key_b"], "left")
    # a place that has met its key goes anywhere: it needs no second one
    spread = F.when(F.col("hot").isNull(), F.col("key_a")).otherwise(F.xxhash64("id", "text_a", "at"))
    met = met.withColumn("go_a", spread)
    met = met.join(rare, (met["go_a"] == rare["to_a"]) & (met["key_b"] == rare["to_b"]), "left")
    last = F.coalesce("hot", "rare")
    goes = last.isNotNull() & ~F.col("id").eqNullSafe(last["last"])
    return met.where(goes).groupBy("id", "text_a", "text_b").agg(F.collect_set("at").alias("dropped"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, text: str = "text",
                doc_id: str = "doc_id") -> DataFrame:
    """Every row as a struct ``row``, with ``kept`` text, ``n_lines`` and ``n_dropped``.

    A null text counts as one empty line and keeps as an empty text. Repeated rows and rows that share an id are one
    document to the counts, and each gets a row of the result. All lines of the last document with a key stay, also
    when it repeats them. Lines shorter than ``min_chars`` stay. An empty table gives no rows.

    The texts are shuffled only if the table of dropped places is too large for Spark to broadcast.
    """
    places = stored(line_places(docs, min_chars, text, doc_id), "line-places")
    repeated = stored(repeated_lines(places, min_docs), "repeated-lines")
    drops = stored(dropped_places(places, repeated), "dropped-lines").select(
        F.col("id").alias("from_id"), F.col("text_a").alias("from_a"), F.col("text_b").alias("from_b"), "dropped")
    rows = _bodies(docs, text, doc_id)
    joined = rows.join(drops, rows["id"].eqNullSafe(drops["from_id"]) & (rows["text_a"] == drops["from_a"])
                       & (rows["text_b"] == drops["from_b"]), "left")
    body = F.coalesce(F.col("row")[text], F.lit(""))
    lines = joined.select("row", body.alias("body"), F.split(body, "\n", -1).alias("lines"),
                          F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    stay = lines.withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped"))
    kept = F.when(F.size("dropped") == 0, F.col("body")).otherwise(
        F.array_join(F.transform("stay", lambda at: F.col("lines")[at]), "\n"))
    return stay.select("row", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"),
                       F.size("dropped").cast("long").alias("n_dropped"))


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, text: str = "text",
                        doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the kept lines as text. A null text stays null."""
    found = dedup_lines(docs, min_docs, min_chars, text, doc_id)
    kept = F.when(F.col("row")[text].isNotNull(), F.col("kept"))
    return found.select(*[(kept if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_documents(spark, sf_dir)).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, trim(translate(line, '{ascii_uppercase}', '{ascii_lowercase}'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM lines
), hot AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), marked AS (
  SELECT keyed.*, hot.key IS NOT NULL AND keyed.doc_id <> hot.last AS goes
  FROM keyed LEFT JOIN hot ON keyed.key = hot.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
