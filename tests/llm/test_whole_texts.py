"""Context trees over whole texts against plain Python: contexts cross words."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poolboard.llm import common, context_tree

from test_models import SAMPLE, tokens


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 7 == 2


def plain_tree(texts, depth):
    """log10 probability of a closed text by dictionaries of bit counts per context and node."""
    counts = {}

    def decide(text):
        raw = b" " + text
        for at in range(1, len(raw)):
            path, node = bytes(reversed(raw[max(0, at - depth):at])).ljust(depth, b"\0"), 1
            for k in range(7, -1, -1):
                yield path, node, raw[at] >> k & 1
                node = node * 2 + (raw[at] >> k & 1)

    for text in texts:
        for path, node, bit in decide(text):
            for d in range(depth + 1):
                counts.setdefault((path[:d], node), [0, 0])[bit] += 1
    estimate = {k: (math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)) / math.log(2)
                for k, (a, b) in counts.items()}
    below, weighted = Counter(), {}
    for path, node in sorted(counts, key=lambda k: -len(k[0])):
        own = estimate[path, node]
        weighted[path, node] = own if len(path) == depth else np.logaddexp2(own, below[path, node]) - 1
        if path:
            below[path[:-1], node] += weighted[path, node]

    def score(text):
        total = 0.0
        for path, node, bit in decide(text):
            p = None
            for d in range(depth, -1, -1):
                if (key := (path[:d], node)) in counts:
                    own = (counts[key][bit] + .5) / (sum(counts[key]) + 1)
                    stop = 2 ** (estimate[key] - 1 - weighted[key])
                    p = own if p is None else stop * own + (1 - stop) * p
            total += math.log10(0.5 if p is None else p)
        return total

    return score


def test_whole_texts_against_a_plain_context_tree(spark, texts):
    rng = random.Random(1)
    rows = SAMPLE + [(n, " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(12)))
                     for n in range(20, 60)]
    closed = {k: b"".join(w.encode() + b" " for w in tokens(t)) for k, t in rows}
    model = plain_tree([closed[k] for k, _ in rows if not held(k)], context_tree.DEPTH)
    found = context_tree.score_whole_texts(texts(rows).repartition(3), context_tree.HELD_OUT).collect()
    assert len(found) == len(rows)
    for r in found:
        expected = model(closed[r.doc_id])
        assert r.held_out == held(r.doc_id) and r.score == pytest.approx(expected, rel=1e-5)
        assert r.bits_per_byte == pytest.approx(-expected / math.log10(2) / len(closed[r.doc_id]), rel=1e-5)
    within = {(r.doc_id, r.n_tokens): tuple(r)[:6] for r in
              context_tree.score_texts(texts(rows), context_tree.HELD_OUT).collect()}
    assert all(within[r.doc_id, r.n_tokens][:5] == tuple(r)[:5] for r in found)


def test_the_order_of_words_counts(spark, tmp_path):
    """Fluent text is likelier than the same words in another order, in the registered query too."""
    words = "alpha beta gamma delta epsilon zeta".split()
    rows = [(n, " ".join(words * 5)) for n in range(200)]
    keys = [n for n in range(1000, 1100) if held(n)][:2]
    rows += [(keys[0], " ".join(words * 5)), (keys[1], " ".join(sorted(words * 5, key=lambda w: w[1:])))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.score for r in context_tree.op6_language_model(spark, str(tmp_path)).where(
        F.col("doc_id").isin(keys)).collect()}
    assert found[keys[0]] > found[keys[1]] + 10


def test_no_texts_and_nothing_to_learn_from(spark, texts):
    found = context_tree.score_whole_texts(texts(SAMPLE), "true").collect()
    assert len(found) == len(SAMPLE) and all(r.bits_per_byte == pytest.approx(8) for r in found)
    assert context_tree.score_whole_texts(texts([]), "false").count() == 0


def test_split_subtrees_are_the_same(monkeypatch):
    raw = " ".join(random.Random(2).choices(["ab", "abc", "ba", "cab", "c"], k=400)).encode() + b" \n "
    grams, counts = np.unique(context_tree.text_grams(raw, np.array([len(raw)])), return_counts=True)
    mine = grams >> 40 == np.bincount(grams >> 40).argmax()
    grams, counts = grams[mine], counts[mine] * (np.arange(mine.sum()) % 5 > 0)
    whole = context_tree.subtree(grams, counts)
    monkeypatch.setattr(context_tree, "GROWN", 4)
    split = context_tree.split_subtree(grams, counts)
    assert split[0] == pytest.approx(whole[0], rel=1e-5) and split[1] == pytest.approx(whole[1], rel=1e-5, nan_ok=True)


def test_long_texts_reach_workers_in_small_batches(spark):
    """While a frame is written, an Arrow batch holds some megabytes of texts at most, not 10,000 of them."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes], "rows": [batch.num_rows]})

    texts = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('x', 5000) AS text")
    found = common.stored(texts.mapInArrow(sizes, "bytes bigint, rows bigint"), "sizes").collect()
    assert sum(r.rows for r in found) == 4000
    assert max(r.bytes for r in found) < 2 * common.BATCH_BYTES < 4000 * 5000
    assert spark.conf.get(common.BATCH_SETTING, None) is None
    spark.conf.set(common.BATCH_SETTING, str(1 << 20))
    try:
        common.stored(texts.mapInArrow(sizes, "bytes bigint, rows bigint"), "sizes")
        assert spark.conf.get(common.BATCH_SETTING) == str(1 << 20)
    finally:
        spark.conf.unset(common.BATCH_SETTING)


def test_grams_are_held_in_pieces(monkeypatch):
    """Pieces give the grams of the whole, wherever texts end, in less memory than all grams of a slice take."""
    rng = random.Random(4)
    ends = [" ".join(rng.choices(["a", "bc", "def"], k=rng.randrange(4))).encode() for _ in range(60)]
    texts = [t + b"\n " if not t else t + b" \n " for t in ends]
    raw, sizes = b"".join(texts), np.array([len(t) for t in texts])
    whole = context_tree.text_grams(raw, sizes)
    alone = [context_tree.text_grams(t, np.array([len(t)])) for t in texts]
    assert (whole == np.concatenate(alone)).all()
    for size in (1, 3, 7, 8, 50):
        monkeypatch.setattr(context_tree, "PIECE_BYTES", size)
        assert (np.concatenate(list(context_tree.gram_pieces(raw, sizes))) == whole).all()
        assert (context_tree.distinct_grams(context_tree.gram_pieces(raw, sizes)) == np.unique(whole)).all()
    counted = context_tree.counted_grams(raw, sizes)
    assert all((a == b).all() for a, b in zip(counted, np.unique(whole, return_counts=True), strict=True))
    monkeypatch.undo()
    raw = (" ".join(rng.choices(["tree", "leaf", "root"], k=1000)) + " \n ").encode() * 1000
    sizes = np.full(1000, len(raw) // 1000)
    tracemalloc.start()
    context_tree.distinct_grams(context_tree.gram_pieces(raw, sizes))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * context_tree.PIECE_BYTES * 8 < 8 * len(raw)


def test_small_batches_fill_a_slice():
    batches = [pa.RecordBatch.from_pydict({"t": ["x" * 1000] * n}) for n in (30, 1, 30, 30, 200, 5)]
    slices = list(common.filled_slices(iter(batches), 60_000))
    assert sum(s.num_rows for s in slices) == 296
    assert all(45_000 <= s.nbytes <= 120_000 for s in slices[:-1])
    assert list(common.filled_slices(iter([]), 10)) == []


def test_the_scores_are_written_in_small_batches(spark, texts, monkeypatch):
    written = []
    keep = common.stored
    monkeypatch.setattr(context_tree, "stored", lambda df, name: written.append(name) or keep(df, name))
    assert context_tree.score_whole_texts(texts(SAMPLE), "false").count() == len(SAMPLE)
    assert written[-1] == "scores"
