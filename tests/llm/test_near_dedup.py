import random
from collections import Counter, defaultdict

import numpy as np

from rillstore.llm import near_dedup
from rillstore.llm.near_dedup import SIMILAR, WORDS, keep_one, near_duplicates, signatures


def multiset(text):
    ws = (text or "").lower().split()
    return Counter(tuple(ws[i : i + WORDS]) for i in range(max(1, len(ws) - WORDS + 1))) if ws else Counter()


def brute(rows):
    """Class of each row by comparing all pairs that share a gram."""
    sets = [multiset(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    having = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            having[g].append(i)
    pairs = {(a, b) for ids in having.values() for x, a in enumerate(ids) for b in ids[x + 1 :]}
    for a, b in pairs:
        both, all_ = (sets[a] & sets[b]).total(), (sets[a] | sets[b]).total()
        if both >= SIMILAR * all_:
            parent[root(a)] = root(b)
    return [root(i) for i in range(len(rows))]


def same_classes(rows, labels, got):
    want = defaultdict(list)
    for (d, _), c in zip(rows, labels, strict=True):
        want[c].append(d)
    found = defaultdict(list)
    for r in got:
        found[r.class_id].append(r.doc_id)
    return sorted(map(sorted, want.values())) == sorted(map(sorted, found.values()))


def test_signatures_are_unbiased():
    draw = np.random.default_rng(4)
    e = draw.integers(0, 2**63, 80).astype(np.uint64)
    for _ in range(5):
        a = draw.integers(0, 14, 80)
        b = np.where(draw.random(80) < 0.6, a, draw.integers(0, 14, 80))
        doc, elements, weights = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), np.r_[e[a > 0], e[b > 0]], np.r_[a[a > 0], b[b > 0]]
        s = signatures(doc, elements, weights, 2, 6000)
        assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.025


def test_equals_brute_force(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = near_duplicates(documents).collect()
    assert len(got) == len(rows) and same_classes(rows, brute(rows), got)
    assert all(r.class_id <= r.doc_id for r in got)


def test_chains_and_groups(spark):
    """A chain of texts, each near the next only, is one class; a group around one text too."""
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    rows, text = [], [word() for _ in range(400)]
    for i in range(30):
        rows.append((i, " ".join(text)))
        text = [*text[8:], *(word() for _ in range(8))]
    base = [word() for _ in range(300)]
    for i in range(100, 180):
        own = list(base)
        for p in draw.sample(range(300), 3):
            own[p] = word()
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(word() for _ in range(120))) for i in range(200, 220)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert same_classes(rows, brute(rows), got)


def template_family():
    """Texts of one template, similar by about 0.75, that meet in many buckets: (number of the pair, text); a pair is similar enough."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(1000)], []
    for n in range(100):
        places = draw.sample(range(5, 995, 5), 24)
        common = {p: word() for p in places[:4]}
        for own in (places[4:14], places[14:]):
            new = common | {p: word() for p in own}
            rows.append((n, " ".join(new.get(p, w) for p, w in enumerate(base))))
    draw.shuffle(rows)
    return rows


def test_template_family(spark):
    rows = template_family()
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got, pairs = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}, defaultdict(list)
    for i, (n, text) in enumerate(rows):
        pairs[n].append((i, multiset(text)))
    for (i, a), (j, b) in pairs.values():
        assert (a & b).total() >= SIMILAR * (a | b).total() and got[i] == got[j]
    # Classes are not one: most texts of different pairs are not similar.
    assert len(set(got.values())) >= 60


def test_cases(hard, empty):
    got = near_duplicates(hard).collect()
    assert len(got) == hard.count()
    sizes = Counter((r.doc_id, r.class_size) for r in got)
    assert sizes[3, 2] == 2 and sizes[1, 1] == 1 and sizes[2, 1] == 1 and sizes[None, 1] == 1
    kept = keep_one(hard)
    assert kept.columns == hard.columns and kept.count() == hard.count() - 1
    assert near_duplicates(empty).count() == 0 and keep_one(empty).count() == 0


def test_short_and_repeated_gram_texts(spark):
    rows = [(1, "a b"), (2, "A  b"), (3, "b a"), (4, "x " * 50), (5, "x " * 47), (6, "x " * 20), (None, "a b")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, None: 1, 3: 3, 4: 4, 5: 4, 6: 6}
    assert near_dedup.similarity(np.array([1, 1, 2], np.uint64).tobytes(), np.array([1, 2, 2], np.uint64).tobytes()) == 0.5


def crowded_template():
    """150 pairs at 0.80 to 0.81 within one template, all other pairs at about 0.76."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(1580)], []
    places = list(range(5, 1575, 10))
    for n in range(150):
        common = {p: word() for p in draw.sample(places, 15)}
        for _ in range(2):
            new = common | {p: word() for p in draw.sample([p for p in places if p not in common], 9)}
            rows.append((n, " ".join(new.get(p, w) for p, w in enumerate(base))))
    draw.shuffle(rows)
    return rows


def similar_pairs(rows):
    """All pairs of rows whose similarity reaches the threshold, by a matrix of the grams (each once in a text)."""
    sets = [multiset(t) for _, t in rows]
    ids = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    there = np.zeros((len(rows), len(ids)), np.float32)
    for i, s in enumerate(sets):
        there[i, [ids[g] for g in s]] = 1
    both, size = there @ there.T, there.sum(1)
    return {(i, j) for i, j in zip(*np.nonzero(both >= SIMILAR * (size[:, None] + size[None, :] - both)), strict=True) if i < j}


def test_crowded_template_loses_no_link(spark):
    rows = crowded_template()
    want = similar_pairs(rows)
    assert want == {(i, j) for i in range(300) for j in range(i + 1, 300) if rows[i][0] == rows[j][0]}
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert len(set(got.values())) == 150 and all(got[i] == got[j] for i, j in want)


def test_copies_of_one_text_are_not_compared_in_all_pairs(spark, monkeypatch):
    """Copies at 0.81 of one text, at 0.65 of each other: all are one class, by a few comparisons each."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(150)], []
    for i in range(1000):
        edited = {p: word() for p in draw.sample(range(5, 145), 0 if i == 500 else 3)}
        rows.append((i, " ".join(edited.get(p, w) for p, w in enumerate(base))))
    verify, compared = near_dedup.verify, []

    def counted(pairs, own):
        compared.append(pairs.count())
        return verify(pairs, own)

    monkeypatch.setattr(near_dedup, "verify", counted)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and len(got) == 1000
    assert sum(compared) < 15 * len(rows)


def test_shuffled_instead_of_broadcast(spark, documents, monkeypatch):
    want = sorted(map(tuple, near_duplicates(documents).collect()))
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, near_duplicates(documents).collect())) == want


def test_any_column_names(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", 1, 2, "x"), (2, "one two three four five six", 3, 4, "y")], "doc_id long, text string, `a.b` int, row long, `kept` string")
    kept = keep_one(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "one two three four five six", 1, 2, "x")]
