import hashlib
from collections import defaultdict

import public_tokenizers
from test_near_dedup import brute as near_classes
from test_secrets import brute as secret_spans
from tokenizers import Tokenizer

import corpus_pipeline
from rillstore.llm import decontaminate, toxicity
from rillstore.llm.secrets import scan


def redacted(text, spans):
    out, at = [], 0
    for s in spans:
        out.append(text[at : max(at, s.start)])
        if s.start >= at:
            out.append("[secret]")
        at = max(at, s.end)
    return "".join(out) + text[at:]


def test_rows_equal_brute_force(spark, documents, sf_dir):
    model = toxicity.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in documents.collect() if model.score(r.text) < toxicity.THRESHOLD]
    first = {}
    for (d, _), c in zip(rows, near_classes(rows), strict=True):
        first[c] = min(d, first.get(c, d))
    rows = [(d, t) for d, t in rows if d in first.values()]
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    whole = lambda t: b" " + decontaminate.normal(t) + b" "
    rows = [(d, t) for d, t in rows if not any(b" " + i + b" " in whole(t) for i in items)]
    # Spans of the added kind depend on all documents, so they come from the scan of what is left here.
    left = spark.createDataFrame([(d, t, r) for (d, t), r in zip(rows, map({x.doc_id: x.source for x in documents.collect()}.get, [d for d, _ in rows]), strict=True)], "doc_id long, text string, source string")
    spans = {r.doc_id: r.spans for r in scan(left, ["doc_id"]).collect()}
    assert all({(s.start, s.rank, s.end) for s in spans[d]} >= set(secret_spans(t)) for d, t in rows)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: library.encode(redacted(t, spans[d]), add_special_tokens=False).ids for d, t in rows}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want)
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in got)


def test_stages_keep_the_columns(spark, hard, sf_dir):
    docs = hard
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
            docs = out
    by_id = defaultdict(int)
    for r in out.collect():
        by_id[r.doc_id] += 1
    assert by_id[3] == 1 and by_id[1] == by_id[2] == 1


def test_empty_documents(spark, empty, sf_dir):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
