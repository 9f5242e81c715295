"""Tokenizers against the public libraries, whole texts and made-up ones."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import EDGE
from tokenizers import Tokenizer, models, pre_tokenizers

from turnwise.llm import bpe, unigram

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a" * 3000, " " * 2000, "<|endoftext|>x<|endoftext|><|endoftext|> y", "\n\n  x  \n", "can't I'll x's", "ab" * 2000 + " <|endoftext|",
       "<unk><unk> x"]


def made_up(n):
    rnd = random.Random(6)
    letters = [chr(c) for c in [*range(300), 0x85, 0xA0, 0x1680, 0x2028, 0x3000, 0x200B, 0x1F600, 0x4E2D, 0xFEFF, 0x301, 0x660]]
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(n)] + ODD


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BPE)
    t.no_padding()
    t.no_truncation()
    return t


def test_ids_and_texts_like_the_library(docs, library):
    texts = made_up(1500) + [r.text for r in docs.collect()]
    words = bpe.Vocabulary(BPE)
    for first in range(0, len(texts), 400):
        part = texts[first:first + 400]
        ids = words.encode(part)
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == want
        assert [words.decode(x) for x in ids] == [library.decode(w, skip_special_tokens=False) for w in want] == part


def test_forgetting_words_and_pairs_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 5)
    words = bpe.Vocabulary(BPE)
    for text in made_up(60):
        assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_as_jobs(edge, none, library):
    got = bpe.encode(edge, BPE, decoded=True).withColumn("again", bpe.decode(F.col("ids"), BPE)).collect()
    assert len(got) == len(EDGE) and all(r.decoded == r.again for r in got)
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in EDGE)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert bpe.encode(none, BPE).collect() == []


def test_counts_like_the_library(docs, edge, none):
    vocabulary = unigram.pieces(PIECES)
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    own = unigram.Counter(vocabulary)
    texts = made_up(1500) + [r.text for r in docs.collect()]
    want = [(len(e.ids), e.ids.count(0)) for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [own.text(x) for x in texts] == want
    got = unigram.count_tokens(edge, PIECES).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted(
        (str(i), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in EDGE)
    assert unigram.count_tokens(none, PIECES).collect() == []


def test_ties_go_to_the_longer_last_piece():
    """Two ways of equal score: the library keeps the one whose last piece starts first."""
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("▁a", -2.0)]
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    own = unigram.Counter(vocabulary)
    for n in range(1, 12):
        text = "a" * n + " zz" * (n % 3)
        assert own.text(text)[0] == len(t.encode(text, add_special_tokens=False).ids)
