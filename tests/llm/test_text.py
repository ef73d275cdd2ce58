"""Tokens by pieces against the library on whole texts; word hashes and shingles against plain Python."""

import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleanmark.llm.textvec import chunks, shingles, word_hashes, words
from gleanmark.llm.tokens import closed, encoder

ODD = ["", None, "a", " a", "a ", "\n\na  b\n c\t\td   ", "x  y  z\n\n q", "don't  it's\n\n\n  we'll", " \n ", "éè ñ  ÄÖ\r\nz", "<|endoftext|> hi", "a<|EndOfText|> b <|startoftext|>", "a\x01b \x01 c", "3½ 4", "   ", "\n", "word\n\n\n word", "\x85 b  c", "a\xa0 b\n\n\xa0c", "x" * 5000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    tool, whole = encoder(P.path(name)), Tokenizer.from_file(P.path(name))
    ids, counts = tool.encode(pa.array(ODD))
    at = np.concatenate([[0], np.cumsum(counts)])
    for i, text in enumerate(ODD):
        assert ids[at[i] : at[i + 1]].tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab' \n\t.é1ſ\xa0", "<|endoftext|>", "<|startoftext|>"]), max_size=20).map("".join), min_size=1, max_size=5))
def test_pieces_on_random_texts(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tool, whole = encoder(P.path(name)), Tokenizer.from_file(P.path(name))
        ids, counts = tool.encode(pa.array(texts, pa.string()))
        assert ids.tolist() == [i for t in texts for i in whole.encode(t, add_special_tokens=False).ids]
        assert counts.sum() == len(ids)


def test_closed_puts_the_end_after_every_text():
    out, at = closed(np.array([5, 6, 7], np.uint32), np.array([2, 0, 1]), 0)
    assert out.tolist() == [5, 6, 0, 0, 7, 0] and at.tolist() == [0, 3, 4, 6]


def test_words_and_shingles():
    texts = ["Aa b c d e f", "aA B c\x0bd e", "", None, " one two ", "a b c d e f"]
    w = words(pa.array(texts))
    assert w.counts.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    h = word_hashes(w, folded=True)
    values, rows = shingles(w, h)
    assert np.bincount(rows, minlength=6).tolist() == [2, 1, 0, 0, 1, 2]
    assert values[0] == values[rows == 1][0] and values[0] != values[1]
    plain = word_hashes(w)
    assert plain[0] != plain[6] and len(set(plain.tolist())) > 8


def test_chunks_cover_all_rows():
    column = pa.array(["x" * 10, "", None, "y" * 100, "z"])
    assert list(chunks(column, 20)) == [(0, 3), (3, 4), (4, 5)]
