import math

import numpy as np

from rillstore.llm import quality_model
from rillstore.llm.catalog import op5_ordinal_quality
from rillstore.llm.runtime import remainder, training_rows


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = docs.where(remainder(docs.doc_id) == 1).select("doc_id")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").join(held, "doc_id").collect()}
    got = [(r.kept, labels[r.doc_id]) for r in op5_ordinal_quality(spark, sf).collect() if r.doc_id in labels]
    assert np.mean([k == bool(q) for k, q in got]) > 0.97


def test_ordered_grades():
    draw = np.random.default_rng(0)
    rows = [(" ".join(["good"] * g + ["bad"] * (3 - g) + ["plain"] * 5), g) for g in draw.integers(0, 4, 400)]
    model = quality_model.fit_rows(rows)
    assert model.grades == (0, 1, 2, 3) and (np.diff(model.thresholds) > 0).all()
    own, score = quality_model.Features(), []
    for g in range(4):
        a, v = own.text(" ".join(["good"] * g + ["bad"] * (3 - g) + ["plain"] * 5))
        p = model.probabilities(np.array([model.weights[a] @ v]))[0]
        assert abs(p.sum() - 1) < 1e-9 and (p >= 0).all()
        score.append(p @ np.arange(4))
    assert score == sorted(score)


def plain(rows, params):
    """The mean loss with the penalty, row by row."""
    own, total = quality_model.Features(), 0.0
    w, raw = params[: quality_model.BUCKETS], params[quality_model.BUCKETS :]
    thresholds = [raw[0] + sum(math.exp(x) for x in raw[1 : i + 1]) for i in range(len(raw))]
    below = lambda k, x: 0.0 if k < 0 else 1.0 if k == len(raw) else 1 / (1 + math.exp(x - thresholds[k]))
    for text, grade in rows:
        x = sum(float(w[a]) * v for a, v in zip(*own.text(text), strict=True))
        total -= math.log(below(grade, x) - below(grade - 1, x))
    return total / len(rows) + quality_model.PENALTY * float(w @ w) / 2


def test_loss_and_gradient():
    draw = np.random.default_rng(2)
    rows = [(" ".join(draw.choice(["good", "bad", "plain", "Text"], 7)), int(g)) for g in draw.integers(0, 3, 20)]
    found = [quality_model.merged(*quality_model.Features().text(t)) for t, _ in rows]
    doc = np.repeat(np.arange(20), [len(a) for a, _ in found])
    at, value, y = np.concatenate([a for a, _ in found]), np.concatenate([v for _, v in found]), np.array([g for _, g in rows])
    params = np.concatenate([draw.normal(0, 0.3, quality_model.BUCKETS), [-0.4, 0.2]])
    params[:-2] *= np.isin(np.arange(quality_model.BUCKETS), at)
    value_, grad = quality_model.loss(params, doc, at, value, y)
    assert abs(value_ - plain(rows, params)) < 1e-9
    for i in [*np.unique(at)[:6].tolist(), len(params) - 2, len(params) - 1]:
        up, down = params.copy(), params.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert abs((plain(rows, up) - plain(rows, down)) / 2e-5 - grad[i]) < 1e-6


def test_scores_equal_a_plain_model(spark, documents, sf_dir):
    model = quality_model.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = {r.doc_id: r for r in quality_model.score(documents, model).collect()}
    for r in documents.collect():
        x = sum(float(model.weights[a]) * v for a, v in zip(*quality_model.Features().text(r.text), strict=True))
        below = [0.0, *(1 / (1 + math.exp(x - t)) for t in model.thresholds), 1.0]
        shares = [b - a for a, b in zip(below, below[1:], strict=False)]
        assert abs(got[r.doc_id].grade - sum(g * p for g, p in zip(model.grades, shares, strict=True))) < 1e-9
        assert abs(got[r.doc_id].tail - shares[-1]) < 1e-9 and got[r.doc_id].kept == (got[r.doc_id].tail >= 0.5)


def test_sample_is_not_shrunk(spark):
    """Labels without a document, and one very long text, leave the sample as large as it can be."""
    docs = spark.createDataFrame([(i, "good words" if i % 2 else "bad words") for i in range(60)] + [(100, "x " * 60_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    assert training_rows(docs, labels, "quality", 20).count() == 20
    assert training_rows(docs, labels, "quality", 500, held_out=None).count() == 60


def test_cases(spark, hard, empty):
    none = spark.createDataFrame([(3, None), (None, 1)], "doc_id long, quality int")
    model = quality_model.fit(hard, none)
    assert [(r.grade, r.tail, r.kept) for r in quality_model.score(hard, model).collect()] == [(0.0, 1.0, True)] * hard.count()
    some = spark.createDataFrame([(3, 0), (4, 1), (7, 2), (5, 1), (8, 0)], "doc_id long, quality int")
    got = quality_model.score(hard, quality_model.fit(hard, some, held_out=None)).collect()
    assert len(got) == hard.count() and all(0 <= r.tail <= 1 and 0 <= r.grade <= 2 for r in got)
    assert quality_model.score(empty, quality_model.fit(empty, some)).count() == 0
