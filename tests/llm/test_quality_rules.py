import re
from collections import Counter

from rillstore.llm.quality_rules import MOST, rules


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    def cover(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        times, inside = Counter(grams), set()
        for i, g in enumerate(grams):
            if times[g] > 1:
                inside.update(range(i, i + n))
        return inside
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover(3)), {n: sum(len(words[i]) for i in cover(n)) / max(1, sum(map(len, words))) for n in MOST}


def test_equals_brute_force(hard, documents):
    for df in (hard, documents):
        want = Counter()
        for r in df.collect():
            n, chars, symbols, dup, repeat, cover = brute(r.text)
            want[(r.doc_id, n, chars, symbols, dup, repeat, n < 50 or 100 * repeat > 50 * n, *(round(c, 9) for c in cover.values()))] += 1
        got = rules(df).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, *(round(r[f"cover_{n}"], 9) for n in MOST)) for r in got) == want
        assert not any(r.kept and r.base_failed for r in got)


def test_empty_table(empty):
    assert rules(empty).count() == 0
