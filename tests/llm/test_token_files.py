import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rillstore.llm import token_files
from rillstore.llm.token_files import count, count_documents, listed


def test_equals_tokenizers(hard, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    for df in (documents, hard):
        want = sorted((repr(r.doc_id), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
        assert sorted((repr(r.doc_id), r.n_tokens) for r in count_documents(df).collect()) == want


def brute(tokens, separator):
    out, start = [], 0
    for i, t in enumerate(tokens):
        if t == separator:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(tokens) - start, False)] if start < len(tokens) else [])


def test_flat_files(spark, tmp_path):
    draw, files = random.Random(1), {}
    for name, separator_share, size in (("a", 0.02, 5000), ("b", 0.0, 3000), ("c", 0.9, 700), ("d", 0.001, 4096), ("e", 1.0, 256)):
        files[name] = [7 if draw.random() < separator_share else draw.randint(8, 60000) for _ in range(size)]
        (tmp_path / name).write_bytes(np.array(files[name], "<u4").tobytes())
    (tmp_path / "none").write_bytes(b"")
    got = {}
    for r in count(listed(spark, f"file://{tmp_path}"), width=4, separator=7, block=512, group=3).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.ordinal, r.start, r.n_tokens, r.terminated))
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {k: brute(v, 7) for k, v in files.items()}
    assert all([x[0] for x in sorted(v)] == list(range(len(v))) for v in got.values())


def test_more_than_two_gigabytes(spark, tmp_path):
    """A file of 2.2 GB, most of it a hole: three documents, and the last one open."""
    size, at = 2_200_000_000, [10, 900_000_000, 1_099_999_990]
    with open(tmp_path / "large file", "wb") as f:
        for p in at:
            f.seek(2 * p)
            f.write(np.array([7], "<u2").tobytes())
        f.truncate(size)
    files = spark.createDataFrame([(f"file://{tmp_path}/large file", size)], "file string, length long")
    got = sorted((r.ordinal, r.start, r.n_tokens, r.terminated) for r in count(files, separator=7, block=1 << 22).collect())
    assert got == [(0, 0, 10, True), (1, 11, 900_000_000 - 11, True), (2, 900_000_001, 1_099_999_990 - 900_000_001, True), (3, 1_099_999_991, 9, False)]


def test_small_blocks_and_cases(documents, empty, tmp_path):
    want = sorted((r.doc_id, r.n_tokens) for r in count_documents(documents).collect())
    files, ids = token_files.write(documents, path=f"file://{tmp_path}/flat")
    assert sorted((r.doc_id, r.n_tokens) for r in count(files, block=64, group=5).join(ids, ["file", "ordinal"]).collect()) == want
    assert count_documents(empty).count() == 0
