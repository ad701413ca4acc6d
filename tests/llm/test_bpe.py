import random
from hashlib import sha256

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skeinlog.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "ΣΑΣ Σ", "İstanbul ǅ", "x" * 5000, "ab" * 3000 + "c", "<|endoftext|>hi<|startoftext|> a", "e\u0301a \u0301x",
       "日本語テキスト 🎉🎉 don't we'll 12345", "\x1c\x1d a\x85b\xa0c", "a\u200bb\u2003c", "!?" * 500, "Ⅷ ½ ٣"]


@pytest.fixture(scope="module")
def model():
    return bpe.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n):
    pick = random.Random(5)
    return ["".join(pick.choice("thaeinosr'!. \n0123éßñ日<|") for _ in range(pick.randint(1, 300))) for _ in range(n)]


def test_ids_and_text_equal_the_library(model, library):
    for text in ODD + random_texts(300):
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(model, text) == ids
        assert bpe.decode(model, ids, "surface") == library.decode(ids, skip_special_tokens=False)


def test_long_piece_keeps_bounded_links(model, library):
    pick, held = random.Random(7), []
    word = "".join(pick.choice("thaein") for _ in range(30_000))
    assert list(bpe.stream(model, word.encode(), held)) == library.encode(word, add_special_tokens=False).ids
    assert max(held) <= 2 * (model["lookahead"] + model["longest"]) + 1


def test_text_decoder_restores_words_across_tokens(model):
    assert bpe.decode(model, bpe.encode(model, "Hello wörld 日本 it's")) == "hello wörld 日本 it 's "


def test_small_memory_of_words_changes_nothing(model, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    text = "one two three four five six one two seven eight one"
    fresh = model | {"state": {}}
    assert bpe.encode(fresh, text) == library.encode(text, add_special_tokens=False).ids


def test_rows(spark, library):
    rows = [(1, "Hello there", "x"), (1, "Hello there", "x"), (2, None, "y"), (3, "", None), (None, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.digests(docs, PATH).collect()}
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids
    assert got == {(i, len(ids(t)), sha256(" ".join(map(str, ids(t))).encode()).hexdigest()) for i, t, _ in rows}
    assert bpe.digests(docs.limit(0), PATH).count() == 0
    back = bpe.decoded(bpe.encoded(docs, PATH), PATH)
    assert {(r.doc_id, r.decoded) for r in back.collect()} == {(1, "hello there "), (2, ""), (3, ""), (None, "z ")}
