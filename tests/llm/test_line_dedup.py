"""Line dedup against plain Python."""

import hashlib
import random

from poolboard.llm import line_dedup

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "this line is long enough to count"


def key_of(line):
    return line.strip(SPACES).translate(LOWER)


def brute(rows, min_docs=3, min_chars=20):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key_of(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            key = key_of(line)
            own = holders[key]
            last = max((d for d in own if d is not None), default=None)
            if len(key) < min_chars or len(own) < min_docs or doc == last:
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(frame, **more):
    got = line_dedup.dedup_lines(frame, **more).select("row.doc_id", "n_lines", "n_dropped", "kept")
    return sorted((tuple(r) for r in got.collect()), key=repr)


EDGES = [(1, None), (2, ""), (3, "\n\n"), (4, f"{LONG}\nshort\n{LONG}"), (5, f"  {LONG.upper()}\t\nshort"),
         (6, f"{LONG}\x0b\n\n{LONG} "), (6, f"x\n{LONG}"), (7, "É" + LONG), (8, "é" + LONG), (9, "É" + LONG),
         (10, "É" + LONG.upper()), (11, "a" * 19), (12, "A" * 19), (13, "a" * 19), (14, "é" * 20), (15, "é" * 20),
         (16, "é" * 20 + "\n" + "é" * 20), (None, f"{LONG}\nof nobody"), (None, None), (4, f"{LONG}\nshort\n{LONG}"),
         (17, " " + "n" * 20), (18, "n" * 20), (19, "n" * 20), (20, "two kelvin K signs are kept apart"),
         (21, "two kelvin k signs are kept apart"), (22, "two kelvin K signs are kept apart")]


def test_edges(spark, texts):
    assert found(texts(EDGES).repartition(5)) == brute(EDGES)


def test_random_lines_and_a_hot_one(spark, texts):
    rng = random.Random(5)
    lines = [f"a line with the number {n} in it" for n in range(60)] + [f"s{n}" for n in range(5)]
    rows = [(n, "\n".join([LONG] * (rng.random() < 0.4) + rng.choices(lines, k=rng.randint(1, 12)))) for n in range(400)]
    assert found(texts(rows).repartition(9)) == brute(rows)
    assert found(texts(rows), min_docs=50, min_chars=2) == brute(rows, 50, 2)


def test_a_very_long_text(spark, texts):
    rows = [(n, "\n".join(f"line {i % 40_000} of many that repeat" for i in range(150_000))) for n in range(3)]
    assert found(texts(rows)) == brute(rows)


def test_columns_stay_and_an_empty_table_gives_no_rows(spark, texts):
    named = texts(EDGES).withColumnsRenamed({"word": "key_a", "part": "row", "source": "dropped"})
    kept = line_dedup.drop_repeated_lines(named)
    assert kept.schema == named.schema and kept.count() == len(EDGES)
    by_text = {(r.doc_id, r.text) for r in kept.collect()}
    assert (1, None) in by_text and (6, f"x\n{LONG}") in by_text and (5, "short") in by_text
    assert line_dedup.dedup_lines(texts(EDGES).limit(0)).collect() == []


def test_no_python_on_the_main_path(spark, texts):
    plan = line_dedup.dedup_lines(texts(EDGES))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_the_query(spark, tmp_path, texts):
    texts(EDGES).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in line_dedup.op12_line_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((d, n, gone, hashlib.sha256(t.encode()).hexdigest()) for d, n, gone, t in brute(EDGES)), key=repr)
