import random

import numpy as np

from rillstore.llm import decontaminate
from rillstore.llm.decontaminate import EDITS, Index, edits_within, leaks, normal


def distance(a, b):
    """Least edit distance of a to a beginning of b, the plain way."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def spoilt(text, k, draw):
    s = list(text)
    for _ in range(k):
        p, how = draw.randrange(len(s)), draw.random()
        if how < 0.33:
            s[p] = draw.choice("etaoin")
        elif how < 0.66:
            del s[p]
        else:
            s.insert(p, draw.choice("etaoin"))
    return "".join(s)


def test_bit_parallel_distance():
    draw = random.Random(5)
    for _ in range(300):
        a = "".join(draw.choice("abc ") for _ in range(draw.randint(10, 70))).encode()
        b = spoilt(a.decode(), draw.randint(0, 6), draw).encode() + b"abc"
        most = draw.randint(0, 8)
        want = distance(a, b[: len(a) + most])
        assert edits_within(a, b[: len(a) + most], most) == (want if want <= most else None)


def recall(index, items, share, seed):
    """Share of the items that are found, each within a text, after the edits; brute force confirms that all are within the radius."""
    draw = random.Random(seed)
    texts = []
    for _, t in items:
        own = normal(t).decode()
        k = int(share * len(own))
        new = own
        while True:  # edits that leave the words' beginnings where a window starts
            new = own[0] + spoilt(own[1:], k, draw)
            if normal(new).decode() == new and distance(own.encode(), new.encode()) <= k:
                break
        texts.append("thion ereat on " + new + " onthe anre")
    found = {(n, index.items[m][0]) for n, m, _, _ in index.search(texts)}
    return sum((n, i) in found for n, (i, _) in enumerate(items)) / len(items)


def test_recall_of_spoilt_items(spark):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    index = Index(items)
    for share, least in ((0.0, 1.0), (0.02, 0.97), (0.04, 0.95), (EDITS, 0.9)):
        assert recall(index, items, share, 1) >= least


def test_recall_of_short_items():
    draw = random.Random(3)
    items = []
    for i in range(400):
        text = ""
        while len(text) < 10 + i % 70:
            text = (text + " " + "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 8)))).strip()
        items.append((i, text))
    index = Index(items)
    for share, least in ((0.0, 1.0), (0.04, 0.95), (EDITS, 0.9)):
        assert recall(index, items, share, 2) >= least


def test_thinning_loses_no_window():
    """Every window within the radius of a short item stays after the thinning: one substitution anywhere."""
    for n in range(10, 40):
        item = "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuv"[:n]
        index = Index([(1, item), (2, "z" * 300)])
        for p in range(n if int(EDITS * n) else 0):
            text = item[:p] + "7" + item[p + 1 :]
            assert 0 in index.starts(np.frombuffer(text.encode(), np.uint8))[0]


def test_leaks_equal_brute_force(spark, sf_dir, documents):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in leaks(documents, items, ["doc_id"]).collect()}
    found = [(i, normal(t)) for i, t in items.collect()]
    texts = {r.doc_id: b" " + normal(r.text) + b" " for r in documents.collect()}
    whole = {(d, i) for d, t in texts.items() for i, own in found if b" " + own + b" " in t}
    assert whole and whole <= got
    for d, i in got - whole:  # anything else must be within the edits
        own, t = dict(found)[i], texts[d].strip()
        starts = [0, *(np.flatnonzero(np.frombuffer(t, np.uint8) == 32) + 1).tolist()]
        most = int(decontaminate.EDITS * len(own))
        assert any(edits_within(own, t[s : s + len(own) + most], most) is not None for s in starts)


def test_blocks_and_cases(spark, hard, empty, documents, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = sorted(map(tuple, leaks(documents, items, ["doc_id"]).collect()))
    assert sorted(map(tuple, leaks(documents, items, ["doc_id"], most=2000).collect())) == whole
    odd = spark.createDataFrame([(1, None), (None, "line one is here line one is here"), (2, ""), (3, "key")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(hard, odd, ["doc_id"]).collect()}
    assert (7, None) in got and (9, 3) in got
    assert leaks(empty, items, ["doc_id"]).count() == 0
    assert leaks(hard, items.limit(0), ["doc_id"]).count() == 0
    left = decontaminate.clean(hard, odd)
    assert left.columns == hard.columns and 7 not in {r.doc_id for r in left.collect()}
    assert decontaminate.clean(hard, items.limit(0)).count() == hard.count()
