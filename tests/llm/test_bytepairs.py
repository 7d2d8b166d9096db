import hashlib
import random
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import cases
from tokenizers import Tokenizer

from quern.llm import bytepairs
from quern.sources.tables import table

PATH = public_tokenizers.path(bytepairs.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)


def encode(texts, codec=None):
    return [np.frombuffer(b, np.int32).tolist() for b in (codec or bytepairs.codec(PATH)).encode(texts)]


def library(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_texts(texts):
    assert encode(texts) == library(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "<|", "'s", "'LL", " ", "  ", "\x1c", "\x85", "\xa0", " ", "\n", "\r\n", "É", "é", "İ", "漢", "😀", "12", "a", "ing", "!!", "\x00"]), max_size=20))
def test_pieces(pieces):
    assert encode(["".join(pieces)]) == library(["".join(pieces)])


def test_every_code_point_beside_others():
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x34000), *range(0xE0000, 0xE0200))]  # the other planes have no letters
    for shape in ("é{}a", "7{} ", "!{}", " {} b"):
        for lo in range(0, len(points), 20_000):
            texts = [shape.format(c) for c in points[lo : lo + 20_000]]
            assert encode(texts) == library(texts)


def test_low_code_points_in_pairs():
    points = [chr(c) for c in range(0x250)]
    for x in points:
        texts = [f"a{x}{y}1" for y in points]
        assert encode(texts) == library(texts)


def test_long_texts_are_cut_where_words_end(monkeypatch):
    monkeypatch.setattr(bytepairs, "PIECE", 7)
    monkeypatch.setattr(bytepairs, "INDEXED", 50)
    monkeypatch.setattr(bytepairs, "HELD", 20)
    monkeypatch.setattr(bytepairs, "DECODED", 3)
    rnd = random.Random(5)
    codec = bytepairs.Codec(PATH)
    for n in (1, 10, 300, 3000):
        texts = ["".join(rnd.choice(["a", "b", "the", " ", "  ", "\n", "\t", "é", " ", "12", "!", "漢"]) for _ in range(n)) for _ in range(5)]
        assert encode(texts, codec) == library(texts)
        for text in texts:
            assert codec.decode(np.frombuffer(codec.encode([text])[0], np.int32)) == text


def test_long_words():
    rnd = random.Random(4)
    for n in (1, 2, 30, 700, 20_000):
        texts = ["".join(rnd.choice("abcdefghiéß") for _ in range(n)), "a" * n, "ab" * n, " " * n]
        assert encode(texts) == library(texts)


@pytest.mark.parametrize("many", [1, 3, 1 << 30])
def test_many_places_at_once(monkeypatch, many):
    """Merging by numpy, or place by place, or both: the same."""
    monkeypatch.setattr(bytepairs, "MANY", many)
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abcdeinrst ") for _ in range(n)) for n in (3, 50, 500, 5000)] + ["inininin the the" * 50, "abababab" * 99]
    assert encode(texts, bytepairs.Codec(PATH)) == library(texts)


def test_words_are_remembered_within_bounds(monkeypatch):
    monkeypatch.setattr(bytepairs, "REMEMBERED", 10)
    codec = bytepairs.Codec(PATH)
    texts = [f"word{i} and{i % 7} the" for i in range(50)]
    for lo in range(0, 50, 5):
        assert encode(texts[lo : lo + 5], codec) == library(texts[lo : lo + 5])
        assert len(codec.known) <= 20


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=40))
def test_any_ids_decode_as_the_library_decodes(ids):
    """Most such lists are no UTF-8."""
    assert bytepairs.codec(PATH).decode(np.array(ids, np.int32)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_vocabulary_out_of_order(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    file["model"]["merges"] = file["model"]["merges"][::-1]
    (tmp_path / "v.json").write_text(json.dumps(file))
    with pytest.raises(ValueError, match="order"):
        bytepairs.Codec(str(tmp_path / "v.json"))


def test_whole_table(spark):
    """Every whole text against the library, both ways."""
    text = {r.doc_id: r.text or "" for r in table(spark, cases.SF, "documents").collect()}
    found = bytepairs.op12_bpe_round_trip(spark, cases.SF).collect()
    assert len(found) == len(text)
    for r in found:
        ids = LIBRARY.encode(text[r.doc_id], add_special_tokens=False).ids
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_odd_rows(spark):
    docs = cases.odd_docs(spark)
    found = bytepairs.encoded(docs.withColumnRenamed("lang", "ids").withColumnRenamed("source", "carried"), PATH)
    assert sorted(found.columns) == ["carried", "doc_id", "ids", "n_chars", "n_tokens"]
    by = {r.doc_id: r for r in found.collect()}
    assert (by[1].ids, by[2].ids, by[2].n_tokens) == ([], [], 0) and by[4].n_tokens > 60_000 and found.count() == 9
    back = {r.doc_id: r.text for r in bytepairs.decoded(found, PATH).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.collect()}
    assert bytepairs.decoded(bytepairs.encoded(cases.docs(spark, []), PATH), PATH).count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (2, [64, None, -5, 10**6, 65], "y")], "a int, ids array<int>, text string")
    back = bytepairs.decoded(odd, PATH).orderBy("a").collect()
    assert [(r.a, r.ids, r.text) for r in back] == [(1, None, ""), (2, [64, None, -5, 10**6, 65], LIBRARY.decode([64, 65]))]
    digests = [hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest() for ids in ([], [64, -1, -5, 10**6, 65])]
    assert [r.ids_sha256 for r in back] == digests
    assert bytepairs.decoded(odd, PATH, keep_ids=False).columns == ["a", "text", "ids_sha256"]


@pytest.mark.parametrize("letters", ["ab", "aetinosr", "abcdefghijklmnopqrstuvwxyz", "漢字仮名", "йцукен", "=", "-=", "0123456789", " ", "a漢é"])
def test_words_beyond_a_window(monkeypatch, letters):
    monkeypatch.setattr(bytepairs, "OVERLAP", 8)
    rnd = random.Random(6)
    codec = bytepairs.Codec(PATH)
    for n in (60, 65, 300, 5_000):
        text = "".join(rnd.choice(letters) for _ in range(n))
        whole = codec.merged([text.encode()])[0]
        for window in (16, 64, 257):
            assert codec.long(text.encode(), window) == whole


def test_words_that_repeat_one_thing_beyond_a_window(monkeypatch):
    monkeypatch.setattr(bytepairs, "OVERLAP", 8)
    codec = bytepairs.Codec(PATH)
    for unit in ("a", "the", "ation", "=", "-=-", "漢", "0"):
        for n in (100, 1_001):
            assert codec.long(unit.encode() * n, 64) == codec.merged([unit.encode() * n])[0]


def test_texts_without_white_space_are_cut_behind_letters(monkeypatch):
    monkeypatch.setattr(bytepairs, "PIECE", 7)
    monkeypatch.setattr(bytepairs, "INDEXED", 64)
    monkeypatch.setattr(bytepairs, "OVERLAP", 8)
    rnd = random.Random(7)
    codec = bytepairs.Codec(PATH)
    for pieces in (["the", "'s", "'", "ll", "1", "_", "."], ["漢", "字", "。", "，", "！", "a", "９", "'s"], ["я", "Я", "-", "ё", "'", "s"], ["a", "b", "c"]):
        texts = ["".join(rnd.choice(pieces) for _ in range(n)) for n in (1, 20, 400, 4_000)]
        assert encode(texts, codec) == library(texts)


def test_a_long_text_without_white_space_needs_little_memory():
    """A process of its own, so that the peak is of this text."""
    code = """
import random, resource, sys
import public_tokenizers
from quern.llm import bytepairs
codec = bytepairs.Codec(public_tokenizers.path(bytepairs.VOCABULARY))
codec.encode(["warm"])
rnd = random.Random(8)
text = "".join("".join(rnd.choices(sys.argv[1], k=10_000)) for _ in range(int(sys.argv[2]) // 10_000))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
codec.encode([text])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / len(text.encode()))
"""
    for letters, n in (("aetinosrhl", 16_000_000), ("漢字仮名交文", 6_000_000)):
        made = subprocess.run([sys.executable, "-c", code, letters, str(n)], capture_output=True, text=True, check=True, timeout=600)
        assert float(made.stdout) < 25
