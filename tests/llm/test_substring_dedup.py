import random
from collections import defaultdict

import numpy as np

from rillstore.llm import substring_dedup
from rillstore.llm.substring_dedup import GEAR, LEAST_SPAN, MOST, cuts, deduplicate, gear, passages, spans


def brute(rows, least):
    """Which characters of each text lie in a substring of `least` characters that another row has too, the plain way."""
    having = defaultdict(set)
    for n, (_, text) in enumerate(rows):
        for i in range(len(text or "") - least + 1):
            having[text[i : i + least]].add(n)
    out = []
    for n, (_, text) in enumerate(rows):
        inside = np.zeros(len(text or ""), bool)
        for i in range(len(inside) - least + 1):
            if len(having[text[i : i + least]]) > 1:
                inside[i : i + least] = True
        out.append(inside)
    return out


def test_gear_is_rolling():
    raw = np.random.default_rng(0).integers(0, 256, 300).astype(np.uint8)
    h, want = 0, []
    for b in raw:
        h = ((h << 1) + int(GEAR[b])) & 0xFFFF
        want.append(h)
    assert gear(raw).tolist() == want


def test_cuts_resist_shifts():
    draw = random.Random(0)
    text = "".join(draw.choice("abcdefgh éü") for _ in range(5000))
    one, two = cuts(text.encode()), cuts(("xyz" + text).encode())
    assert len(set(one) & {c - 3 for c in two}) > 0.95 * len(one)
    assert one[-1] == len(text.encode()) and max(np.diff([0, *one])) <= MOST + 4


def test_against_independent_search(spark, documents, hard):
    """Every span stands word for word in another row; all text that another row has too is found but for the chunks at its ends."""
    for df in (documents, hard):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        numbered = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").coalesce(1)
        got = {r.doc_id: r for r in passages(numbered).collect()}
        shared = brute(rows, LEAST_SPAN)
        long = brute(rows, LEAST_SPAN + 2 * MOST)
        for i, (_, text) in enumerate(rows):
            found = np.zeros(len(text or ""), bool)
            for s in got[i].spans if i in got else ():
                span = text[s.at : s.end]
                assert len(span) >= LEAST_SPAN and any(span in (t or "") for j, (_, t) in enumerate(rows) if j != i)
                found[s.at : s.end] = True
            assert not (found & ~shared[i]).any()
            if long[i].any():
                assert i in got


def test_windows_are_joined_as_they_stand():
    part = lambda at, end, row, there: {"at": at, "end": end, "other": {"row": row, "at": there}}
    assert spans([part(0, 90, 7, 10), part(40, 130, 7, 50), part(80, 170, 8, 3), part(400, 500, 8, 9)]) == [{"at": 0, "end": 130}, {"at": 80, "end": 170}, {"at": 400, "end": 500}]


def planted(draw, longest, words, n):
    word = lambda: "".join(draw.choice("abcdefghijklm") for _ in range(draw.randint(1 if longest < 7 else 2, longest)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(words) for _ in range(n)]
    rows = [(i, f"{prose(draw.randint(5, 80))} {s} {prose(draw.randint(5, 80))}") for i, s in enumerate(shared * 2)]
    return rows + [(i, prose(150)) for i in range(10_000, 10_100)]


def test_planted_passages(spark):
    """Passages of 51 words in two documents: nearly all are found, also with words of one to six letters."""
    for longest, least in ((9, 0.99), (6, 0.93)):
        rows = planted(random.Random(longest), longest, 51, 400)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got, texts = {r.doc_id: r for r in passages(df).collect()}, dict(rows)
        assert max(got) < 10_000 and len(got) >= least * 800
        for d, r in got.items():
            assert all(texts[d][s.at : s.end] in texts[(d + 400) % 800] for s in r.spans)
    left = {r.doc_id: r.text for r in deduplicate(df).collect()}
    assert all(left[i] == t for i, t in rows if i >= 10_000)
    for i in range(400):
        assert len(left[i]) + len(left[i + 400]) < len(texts[i]) + len(texts[i + 400]) or i not in got


def test_repeats_within_one_row(spark):
    draw = random.Random(1)
    prose = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = prose(60)
    df = spark.createDataFrame([(1, f"{prose(30)} {passage} {prose(20)} {passage} {prose(9)}", 5)], "doc_id long, text string, `a.b` int")
    assert passages(df).count() == 0
    got = passages(df, within=True).first()
    assert len(got.spans) == 2 and len(got.cut) == 1
    left = deduplicate(df, within=True)
    assert left.columns == df.columns and len(left.first().text) < len(df.first().text) - 200
    assert passage in left.first().text


def test_cases(hard, empty):
    left = deduplicate(hard)
    assert left.columns == hard.columns and left.count() == hard.count()
    assert passages(empty).count() == 0 and deduplicate(empty).count() == 0
    assert substring_dedup.cuts(b"") == []
