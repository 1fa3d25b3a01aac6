import itertools
import random

import pytest
from tokenizers import Tokenizer

from daftar.llm import chunk
from daftar.llm.tokenize import TOKENIZER_DIR, token_ids, vocabulary

WORDS = ["كلمة", "word", "x" * 30, "é", "١٢", "."]


def random_text(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", ". ", "\n", "\n\n", "، ", ""]) for _ in range(n))


@pytest.mark.parametrize("seed", range(8))
def test_pieces_give_the_text_back(seed):
    rng = random.Random(seed)
    for n in (0, 1, 50, 400):
        text = random_text(rng, n)
        cut = chunk.cuts(text)
        assert "".join(text[b:e] for _, b, e, _ in cut) == text
        assert all(0 <= b - g <= chunk.OVERLAP and e - g <= chunk.LIMIT and e > b for g, b, e, _ in cut)
        assert (len(cut) > 1) == (len(text) > chunk.LIMIT)


def test_edits_stay_local():
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "one.", "two,"]) for _ in range(4000))
    edited = text[:300] + "inserted words " + text[300:]
    a = {text[b:e] for _, b, e, _ in chunk.cuts(text)}
    b = {edited[x:e] for _, x, e, _ in chunk.cuts(edited)}
    assert len(a & b) >= 0.6 * len(a)


def test_forced_and_natural(spark):
    rows = spark.createDataFrame([("a", "x" * 2500), ("b", "word " * 400), ("c", "short"), ("d", None), ("e", ""), ("f", "y" * 1000), ("g", "z" * 1001), ("b", "word " * 400), ("h", "w" * 600 + " " + "w" * 600)], "id string, text string")
    pieces = chunk.pieces(rows.withColumn("piece", rows.id), "id", "text")
    assert {(r.id, r.cut) for r in chunk.oversized(pieces, "id").collect()} == {("a", "forced"), ("b", "natural"), ("g", "forced"), ("h", "natural")}
    got = pieces.collect()
    assert all(len(r.piece) <= 1000 and r.overlap <= 100 for r in got)
    for key, text in (("a", "x" * 2500), ("b", "word " * 400), ("h", "w" * 600 + " " + "w" * 600)):
        own = sorted((r for r in got if r.id == key), key=lambda r: r.piece_no)
        assert "".join(r.piece[r.overlap :] for r in own) == text
        assert any(r.forced for r in own) == (key == "a")
    assert chunk.pieces(rows.limit(0), "id", "text").count() == 0


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_public_library(spark, public):
    rng = random.Random(2)
    letters = " \n\t'　asbé٣م12.,\x1c​字😀"
    texts = ["", " ", "a  b   c", "it's <|endoftext|> ok", "ab" * 20_000, "قو" * 5_000, "مادة ٧: يلتزم صاحب العمل."] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(10_000, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in token_ids(rows.withColumn("ids", rows.doc_id), "doc_id", "text").collect()}
    assert got.pop(10_000) == []
    want = [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]
    assert all(got[i] == w for i, w in enumerate(want))
    assert token_ids(rows.limit(0), "doc_id", "text").count() == 0


BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2003\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def test_white_space_of_every_kind_is_cut_as_the_public_library_cuts_it(public):
    import base64

    import tiktoken

    from daftar.llm.tokenize import _pattern

    with open(f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=_pattern(TOKENIZER_DIR), mergeable_ranks=ranks, special_tokens={})
    rng, v = random.Random(11), vocabulary()
    texts = ["".join(t) for n in range(1, 6) for t in itertools.product("a \xa0", repeat=n)] + [" \xa0 \xa0"]
    texts += ["".join(rng.choice(BLANKS + "    a.7'م") for _ in range(rng.randint(0, 14))) for _ in range(30_000)]
    assert [t for t in texts if v.encode(t) != library.encode_ordinary(t)] == []
    some = texts[:4000]
    assert [v.encode(t) for t in some] == [e.ids for e in public.encode_batch(some, add_special_tokens=False)]


def test_merges_alone(public):
    v = vocabulary()
    for word in ["a", "ab", "hello", "zzzzzzzzz", "αβγδ"]:
        assert v.merge(word.encode()) == public.encode(word, add_special_tokens=False).ids
