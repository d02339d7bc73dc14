import re
from collections import Counter

from rillstore.llm.licenses import DICE, TEMPLATES, Templates, all_templates, scan


def plain_bigrams(words):
    return Counter(zip(words, words[1:], strict=False))


def plain_words(text):
    return re.findall(r"[^\W_]+(?:\.[^\W_]+)*", text.lower())


def brute(text):
    """The best coefficient of any window of words with each short template, without pruning, shingles or lines."""
    ws, out = plain_words(text), {}
    for name, template in TEMPLATES.items():
        want = plain_bigrams(plain_words(template))
        n = want.total()
        if n > 20:
            continue
        best = 0.0
        for i in range(len(ws)):
            have = Counter()
            for j in range(i + 1, min(len(ws), i + 2 * n + 2)):
                have[ws[j - 1], ws[j]] += 1
                best = max(best, 2 * (have & want).total() / (j - i + n)) if (ws[j - 1], ws[j]) in want else best
        if best >= DICE:
            out[name] = best
    return out


def test_equals_brute_force(spark, documents):
    docs = documents.where("length(text) < 4000")
    odd = ["released under the mit license yesterday. licensed under cc by 4.0", "so: this work is licensed under a gnu general public license, version 3, all rights reserved", "licensed under the cc by nc 4.0 and the mit license"]
    docs = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = {}
    for r in scan(docs).collect():
        got.setdefault(r.doc_id, {})[r.license] = max(r.dice, got.get(r.doc_id, {}).get(r.license, 0))
    want = {r.doc_id: b for r in docs.collect() if (b := brute(r.text))}
    short = {n for n, t in TEMPLATES.items() if len(plain_words(t)) <= 21}
    assert want and set(want) == {d for d, g in got.items() if short & set(g)}
    for d, b in want.items():
        # Where templates overlap, the closer one of at least the same length is reported.
        assert max(got[d].values()) >= max(b.values()) - 1e-9


def test_whole_texts(spark):
    """Every licence is found as a whole, on its own lines, on one line, and with some words changed."""
    prose = " ".join(f"word{i} of the" for i in range(60))
    rows, names = [], list(all_templates())
    for i, text in enumerate(all_templates().values()):
        ws = text.split()
        changed = [w if k % 40 else "changed" for k, w in enumerate(ws)]
        rows += [(3 * i, text), (3 * i + 1, f"{prose} {' '.join(ws)} {prose}"), (3 * i + 2, f"{prose}\n{' '.join(changed) if len(ws) > 60 else text}\n{prose}")]
    got = {}
    for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert len(names) >= 28
    for d, _ in rows:
        assert names[d // 3] in got[d]


def test_wrapped_templates_and_changes(spark):
    ws = TEMPLATES["isc"].split()
    ws[5], ws[40] = "changed", "words"
    lines = [" ".join(ws[i : i + 9]) for i in range(0, len(ws), 9)]
    rows = [(1, "\n".join(["before it some text", *lines, "and some after it"])), (2, "nothing here\nat all"), (3, TEMPLATES["mit-notice"].upper()), (4, None), (5, "")]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 3} and got[1].license == "isc" and (got[1].first_line, got[1].end_line) == (1, 1 + len(lines))
    assert got[3].license == "mit-notice" and got[3].dice == 1.0


def test_notices_within_lines():
    found = lambda text: {(m[0], m[1], m[2], m[3]) for m in Templates(TEMPLATES, DICE).matches(text)}
    assert found("first\nCopyright 2020 Foo Inc. All rights reserved.") == {("all-rights-reserved", 1.0, 1, 2)}
    assert found("Licensed under the MIT License. See LICENSE for details.") == {("mit-notice-licensed", 1.0, 0, 1)}
    for name, template in TEMPLATES.items():
        prose = " ".join(f"word{i} of the" for i in range(60))
        assert (name, 1.0, 0, 1) in found(f"{prose} {template} {prose}")
        words = f"{prose} {template} {prose}".split()
        cut = "\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7))
        assert name in {m[0] for m in found(cut)}


def test_cases(hard, empty):
    assert scan(hard).count() == 0 and scan(empty).count() == 0
    assert Templates({"none": "", "one": "word"}, DICE).matches("word") == []
