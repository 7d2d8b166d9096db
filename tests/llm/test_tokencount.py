import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import cases
from tokenizers import Tokenizer

from quern.llm import tokencount

PATH = public_tokenizers.path(tokencount.VOCABULARY)
MERGER = tokencount.Merger(PATH)
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert MERGER.count(text) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "'s", "'LL", " ", "\x1c", "\x85", "\xa0", "\n", "É", "e\u0301", "İ", "Σ", "ß", "漢", "😀", "12", "a", "ing", "!!", "\x00"]), max_size=20))
def test_pieces(pieces):
    text = "".join(pieces)
    assert MERGER.count(text) == library(text)


def test_every_code_point_beside_others():
    """Every code point after a letter, a digit, a sign and a blank, and before a letter."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for shape in ("é{}a", "7{} ", "!{}", " {}b"):
        for lo in range(0, len(points), 20_000):
            texts = [shape.format(c) for c in points[lo : lo + 20_000]]
            want = [len(e.ids) for e in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]
            assert [MERGER.count(t) for t in texts] == want


def test_low_code_points_in_pairs():
    """Texts that the compiled pattern cuts: all pairs of code points below U+0250."""
    points = [chr(c) for c in range(0x250)]
    for x in points:
        texts = [f"a{x}{y}1" for y in points]
        assert [MERGER.count(t) for t in texts] == [len(e.ids) for e in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]


def test_long_words():
    rnd = random.Random(4)
    for n in (1, 2, 30, 700, 5000):
        word = "".join(rnd.choice("abcdefghiéß") for _ in range(n))
        assert MERGER.count(word) == library(word)
        assert MERGER.count("a" * n) == library("a" * n)


def test_whole_table(spark):
    """Every whole text against the library."""
    from quern.sources.tables import table

    text = {r.doc_id: r.text for r in table(spark, cases.SF, "documents").collect()}
    found = tokencount.op2_token_counts(spark, cases.SF).collect()
    assert len(found) == len(text)
    for r in found:
        n = library(text[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 2048)


def test_odd_rows(spark):
    found = tokencount.token_counts(cases.odd_docs(spark).withColumnRenamed("lang", "n_tokens"), PATH)
    by = {r.doc_id: r for r in found.collect()}
    assert (by[1].n_bytes, by[1].n_tokens, by[2].n_tokens) == (0, 0, 0) and by[4].n_tokens > 60_000 and found.count() == 9
    assert tokencount.token_counts(cases.docs(spark, []), PATH).count() == 0
