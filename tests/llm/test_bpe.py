import hashlib
import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from rillstore.llm import bpe, runtime
from rillstore.llm.lexicon import compile_words, mapped

NAME = "byte_bpe_50k.json"


def test_equals_tokenizers(hard, documents):
    library = Tokenizer.from_file(public_tokenizers.path(NAME))
    for df in (hard, documents):
        want = []
        for r in df.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(df, ["doc_id"]).collect()]
        assert Counter(got) == Counter(want)


def test_round_trip(documents):
    for r in bpe.encode(documents, ["doc_id", "text"]).collect():
        assert r.decoded == r.text and len(r.ids) == r.n_tokens


def test_lexicon_against_dict():
    draw = random.Random(3)
    words = {bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 7))): (i, i * 2) for i in range(600)}
    lexicon = mapped(compile_words(words.items()))
    probes = [*words, b"", b"abcabcabcabc", b"d", *(w + b"z" for w in words)]
    for probe, rank in zip(probes, lexicon.ranks(probes).tolist(), strict=True):
        assert (tuple(lexicon.ids(rank)) if rank >= 0 else None) == words.get(probe)
    assert len(lexicon.final) < sum(map(len, words)) / 4  # suffixes are shared


def test_long_pieces_merge_alike():
    library, own = Tokenizer.from_file(public_tokenizers.path(NAME)), bpe.Vocabulary(public_tokenizers.path(NAME))
    for text in ("x" * 5000, "theand" * 400, "€ü" * 300):
        assert [i for p in own.split(text) for i in own.merge(p.encode())] == library.encode(text, add_special_tokens=False).ids


def test_frequent_words_are_looked_up_once(monkeypatch):
    """Words of the lexicon stay when others are forgotten; ids equal the library's throughout."""
    monkeypatch.setattr(bpe, "REMEMBERED", 60)
    library, v = Tokenizer.from_file(public_tokenizers.path(NAME)), bpe.Vocabulary(public_tokenizers.path(NAME))
    words = [b" house", b" garden", b" the"]
    lexicon, asked = mapped(compile_words((w, tuple(v.merge(w))) for w in words)), Counter()
    ranks = lexicon.ranks
    monkeypatch.setattr(lexicon, "ranks", lambda ws: (asked.update(ws), ranks(ws))[1])
    own = bpe.Encoder(v, lexicon)
    for n in range(8):
        texts = ["in the house" + "".join(f" ra{chr(97 + n)}{chr(97 + k)}xq" for k in range(25)), " the garden<|endoftext|>é😀\n", "", None]
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert own.batch(texts) == [(",".join(map(str, i)), library.decode(i, skip_special_tokens=False)) for i in want]
    assert [asked[w] for w in words] == [1, 1, 1]


def test_decoded_text_comes_from_the_ids():
    v = bpe.Vocabulary(public_tokenizers.path(NAME))
    the = v.id_of[b" the"]
    v.bytes_of[the], v.size_of[the] = b"\xff?", 2
    assert [t for _, t in bpe.Encoder(v, mapped(compile_words([]))).batch(["in the house", "a house"])] == ["in\ufffd? house", "a house"]


def test_workers_release_what_other_operators_keep():
    runtime.kept("a")["x"] = runtime.kept("b")["x"] = 1
    runtime.release("a")
    assert runtime.kept("a") == {"x": 1} and runtime.kept("b") == {}
    runtime.release()
    assert runtime.kept("a") == {}


def test_empty_table(empty):
    assert bpe.encode(empty, ["doc_id"]).count() == 0
