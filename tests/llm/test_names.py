"""Columns whose names have dots or are those of results, in every operator that carries columns along."""

import pytest

from rillstore.llm import bpe, decontaminate, substring_dedup, toxicity

KINDS = "doc_id long, text string, `a.b` int, score string, item_id int, ids string, kept string, predicted int, row int, n_tokens int"


@pytest.fixture
def odd(spark):
    text = "you stupid idiot and line one is here line one is here then"
    return spark.createDataFrame([(1, text, 5, "s", 6, "i", "k", 7, 8, 9), (None, None, None, None, None, None, None, None, None, None)], KINDS)


def test_toxicity(odd):
    model = toxicity.fit_rows([("good plain words and more of the usual text here", 0), ("you stupid idiot and worthless clown go away", 1)] * 300)
    got = toxicity.score(odd, model, ["a.b", "score", "predicted"])
    assert got.columns == ["a.b", "kept_score", "kept_predicted", "score", "predicted"]
    assert {(r["a.b"], r.kept_score, r.predicted) for r in got.collect()} == {(5, "s", 1), (None, None, 0)}
    assert toxicity.reject(odd, model).columns == odd.columns and toxicity.reject(odd, model).count() == 1


def test_decontaminate(odd, spark):
    items = spark.createDataFrame([(3, "line one is here line one is here")], "item_id long, text string")
    got = decontaminate.leaks(odd, items, ["a.b", "item_id", "text"])
    assert got.columns == ["a.b", "kept_item_id", "text", "item_id", "edits", "place"]
    assert [(r["a.b"], r.kept_item_id, r.item_id) for r in got.collect()] == [(5, 6, 3)]
    left = decontaminate.clean(odd, items)
    assert left.columns == odd.columns and [r.doc_id for r in left.collect()] == [None]


def test_bpe(odd):
    got = bpe.encode(odd, ["a.b", "ids", "n_tokens"])
    assert got.columns == ["a.b", "kept_ids", "kept_n_tokens", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    assert {(r["a.b"], r.kept_ids, r.n_tokens > 5) for r in got.collect()} == {(5, "i", True), (None, None, False)}


def test_substring_dedup(odd):
    assert substring_dedup.deduplicate(odd).columns == odd.columns and substring_dedup.deduplicate(odd).count() == 2
