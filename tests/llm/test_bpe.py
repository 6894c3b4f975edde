import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fingerloom.llm.bpe import PairIndexBpe, encode_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a<|endoftext|>b <|startoftext|>", "ΑΣΑΣ ΟΔΟΣ İstanbul 东京 🎉 don't we'll ½ x²", "\x85\x1c\x1d q", "a" * 3000, "éİ ſ K Å ǅ", "it'S ''s 's't", "\x00\x01 \x7f", "_a_b 12 3.4 ا ب", "<|ENDOFTEXT|>", "ﬁ ẞ ÿ Ÿ Ɐ"]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def own():
    return PairIndexBpe(open(PATH, encoding="utf-8").read())


def test_as_the_library(own, library):
    for text, (n, ids, decoded) in zip(ODD, own.encode_batch(ODD)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), text
        assert n == len(want)
        assert decoded == library.decode(want, skip_special_tokens=False)
        assert own.decode(own.encode(text)) == decoded


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    library, own = Tokenizer.from_file(PATH), _own()
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


_kept = []


def _own():
    if not _kept:
        _kept.append(PairIndexBpe(open(PATH, encoding="utf-8").read()))
    return _kept[0]


def test_small_cache_gives_the_same(own, monkeypatch):
    from fingerloom.llm import bpe

    texts = ["some words and others", "and others again", "x" * 100 + " some"] * 3
    want = own.encode_batch(texts)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 2)
    assert [own.encode_batch([t])[0] for t in texts] == want


def test_rows(spark):
    rows = [(1, "Hello there", 9), (1, "Hello there", 9), (None, None, 9), (2, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = sorted(map(tuple, encode_documents(docs, PATH).collect()), key=lambda r: (r[0] is None, r))
    nothing = hashlib.sha256(b"").hexdigest()
    assert [r[0] for r in found] == [1, 1, 2, None]
    assert found[0] == found[1] and found[0][1] == 2
    assert found[2][1:] == found[3][1:] == (0, nothing, nothing)
    assert encode_documents(docs.limit(0), PATH).count() == 0
    full = encode_documents(docs, PATH, with_text=True).filter("doc_id = 1").first()
    assert len(full.ids) == 2 and full.decoded == "hello</w> there</w>"
