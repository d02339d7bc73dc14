import zlib

import zstandard

from rillstore.llm import toxicity
from rillstore.llm.catalog import op10_compression_toxicity
from rillstore.llm.runtime import remainder


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in op10_compression_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    caught = [labels[r.doc_id] for r in held if r.predicted]
    assert sum(caught) / len(caught) > 0.85
    assert sum(caught) / sum(labels[r.doc_id] for r in held) > 0.6
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in held)


def test_held_out_column_and_cases(spark, hard, empty):
    labels = spark.createDataFrame([(3, 1), (4, 0), (7, None), (None, 1), (5, 1), (8, 0)], "doc_id long, toxic int")
    model = toxicity.fit(hard, labels)
    got = toxicity.score(hard, model, ["doc_id"]).collect()
    assert len(got) == hard.count() and all(r.score is not None for r in got)
    assert toxicity.score(empty, toxicity.fit(empty, labels), ["doc_id"]).count() == 0
    left = toxicity.reject(hard, model)
    assert left.columns == hard.columns


def test_remainder_is_crc32(spark):
    ids = spark.range(50)
    got = ids.select("id", remainder(ids.id).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 3 for r in got)


def plain_lengths(model, text):
    """Each window's bytes with the ordinary dictionary alone and with the toxic one before it, without any shortcut."""
    how = lambda: zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    tool = lambda book: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how())
    ws = toxicity.words(text)
    cut = [(" " + " ".join(ws[i : i + toxicity.WINDOW]) + " ").encode() for i in range(0, len(ws), toxicity.WINDOW)]
    return [(len(tool(model.ordinary).compress(w)), len(tool(model.toxic + model.ordinary).compress(w))) for w in cut]


def test_excess_equals_plain_compression(spark):
    """Windows and lengths against plain compression of every window; those that share nothing with the toxic dictionary save next to nothing."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.toxic and model.weights
    skipped = []
    for r in docs.orderBy("doc_id").limit(12).collect():
        excess, tried = model.windows(r.text)
        lengths = plain_lengths(model, r.text)
        assert len(lengths) == len(excess)
        for i, (a, b) in enumerate(lengths):
            if i in tried:
                assert excess[i] == a - b
            else:
                skipped.append(a - b)
    assert max(skipped) <= 3 and sum(s > 1 for s in skipped) < 0.02 * len(skipped)


def test_windows_skipped_have_no_matches():
    rows = [("good plain words and more of the usual text here", 0), ("you stupid idiot and worthless clown go away", 1)] * 300
    model = toxicity.fit_rows(rows)
    assert model.score("what a stupid idiot you are") > model.score("good plain words here")
    assert model.score(None) == model.score("") and 0 <= model.score("") <= 1
