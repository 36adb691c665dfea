"""What the quality ranking is fitted on when labelled rows are repeated."""

from poolboard.llm import classifier


def fitted_on(monkeypatch, docs, labels, sample):
    shapes, fit = [], classifier.fit
    with monkeypatch.context() as m:
        m.setattr(classifier, "fit", lambda x, good: shapes.append((x.tolist(), good.tolist())) or fit(x, good))
        classifier.train(docs, labels, "true", sample)
    return shapes[0]


def test_repeated_rows_count_once_and_the_bound_holds_for_rows(spark, texts, monkeypatch):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    rows = [(1, "a good text."), (2, "BAD!! BAD!!")]
    once = fitted_on(monkeypatch, texts(rows), labels, 10)
    assert fitted_on(monkeypatch, texts(rows + rows[:1] * 300), labels, 10) == once and len(once[0]) == 2
    many = texts(rows + [(1, "word " * n) for n in range(1, 60)])
    found = fitted_on(monkeypatch, many, labels, 10)
    assert len(found[0]) == 10 and found[1].count(False) == 1 and fitted_on(monkeypatch, many.repartition(5), labels, 10) == found
