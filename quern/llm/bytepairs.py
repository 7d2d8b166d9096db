"""Byte-level BPE encoding and decoding with a pair occurrence index.

A task takes its texts in bounded chunks and cuts them into words. The distinct words of a chunk that it has not met before
stand in one sequence of symbols, a gap behind each, and an index maps every adjacent pair that has a rank to all its
positions. The lowest active rank is taken; all positions of its pair are merged from left to right, and the pairs that this
makes with the neighbours go to the lists of their own ranks. Since both halves of a merge are made by merges of lower rank,
which is checked when the vocabulary is read, new pairs have higher ranks, so that each rank is applied once, and every word
comes out as if it had been merged alone.

A text of code points below U+0250, about which all Unicode versions agree, is cut by a compiled pattern; any other by the
library's own cutter. Long texts are cut in pieces where no word goes on: before white space behind something else, or
before a sign or a digit behind a letter.

A word too long to be indexed at once is merged in overlapping windows. A sequence of symbols is what merging gives if and
only if it is so for each two neighbours alone: the first merge across a border would be made of these two alone as well,
as ranks are applied in ascending order. So where a border of one window's symbols is one of the next window's too, and
merging the two symbols at it gives these two, what stands before it and behind it are put together. Windows that agree
nowhere are taken larger.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from quern.llm.bytesweep import chunks
from quern.llm.shared import apart, over_texts, together, with_fields
from quern.llm.tokencount import byte_letters
from quern.sources.tables import table

VOCABULARY = "byte_bpe_50k.json"
#: Words whose ids a task remembers, and the longest such word.
REMEMBERED, LONGEST = 400_000, 64
#: Bytes of texts in a chunk, of new words that are indexed at once; characters of a text that are cut at once, words that
#: are held at once, ids that are decoded at once.
CHUNK, INDEXED, PIECE, HELD, DECODED = 1 << 22, 1 << 20, 1 << 18, 1 << 19, 1 << 18
#: Fixed value of the vocabulary's kind: how it cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space below U+0250.
BLANK = "\t-\r \x85\xa0"
#: Letters and signs of which all Unicode versions agree that they are, and where a long text may be cut.
LETTER = "A-Za-z\u0430-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5"
BORDER = re.compile(rf"(?<=\S)[ \n]|(?<=[{LETTER}])(?=[!-@\[-`{{-~\u3001\u3002\uff01-\uff0f\uff1a-\uff20])")
ONE_WORD = re.compile(f"[{LETTER}]+")
#: Bytes that two windows of a long word share at first.
OVERLAP = 1 << 12
GAP, GONE = -1, -2
#: From so many places on, numpy merges them.
MANY = 64


class Decoder:
    """decode(ids) by a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.read(path, json.load(f))

    def read(self, path: str, file: dict) -> None:
        of_letter = {letter: b for b, letter in byte_letters().items()}
        self.raw = {i: bytes(map(of_letter.__getitem__, token)) for token, i in file["model"]["vocab"].items()}
        self.raw |= {t["id"]: t["content"].encode() for t in file["added_tokens"]}

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; unknown ids give nothing, bytes that are no UTF-8 the replacement character."""
        get = self.raw.get
        parts = [b"".join([get(i, b"") for i in ids[lo : lo + DECODED].tolist()]) for lo in range(0, len(ids), DECODED)]
        return b"".join(parts).decode("utf-8", "replace")


class Codec(Decoder):
    """encode(texts), decode(ids) by a vocabulary file."""

    def read(self, path: str, file: dict) -> None:
        super().read(path, file)
        vocab = file["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        letters = byte_letters()
        known = set(letters.values())
        for x, y in merges:
            if x not in known or y not in known or x + y in known:
                raise ValueError(f"merges of {path} are not in an order in which each makes a new symbol of earlier ones")
            known.add(x + y)
        self.bits = bits = max(vocab.values()).bit_length()
        #: Of each rank the two symbols and what they make; of each pair its rank.
        self.merges = [(vocab[x], vocab[y], vocab[x + y]) for x, y in merges]
        self.ranks = {x << bits | y: rank for rank, (x, y, _) in enumerate(self.merges)}
        self.pairs = np.array(sorted(self.ranks), np.int64)
        self.rank_of = np.array([self.ranks[pair] for pair in self.pairs.tolist()], np.int64)
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.length = np.zeros(max(self.raw) + 1, np.int64)
        self.length[list(self.raw)] = list(map(len, self.raw.values()))
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special = {s: array("i", [i]).tobytes() for s, i in special.items()}
        self.parts = re.compile("|".join(map(re.escape, special))) if special else None
        low = PATTERN.replace(r"\s+(?!\S)|\s+", f"[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+").replace(r"[^\s\p{L}\p{N}]", rf"[^{BLANK}\p{{L}}\p{{N}}]")
        self.words = regex.compile(low)
        self.beyond = re.compile("[^\x00-\u024f]")
        self.cutter = pre_tokenizers.Split(Regex(PATTERN), "isolated")
        #: Ids of words met before: lately, and before that.
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as 32-bit integers."""
        raw = b"\0" + b"\0".join(words) + b"\0"
        edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
        start = self.first[np.frombuffer(raw, np.uint8)]
        start[edges] = GAP
        n = len(start)
        pair = start[:-1].astype(np.int64) << self.bits | start[1:]
        pair[(start[:-1] < 0) | (start[1:] < 0)] = -1
        keys, of = np.unique(pair, return_inverse=True)
        order, upto = np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=len(keys)))
        get, bits = self.ranks.get, self.bits
        places: dict[int, array] = {}
        for key, lo, hi in zip(keys.tolist(), [0, *upto[:-1].tolist()], upto.tolist(), strict=True):
            if (rank := get(key)) is not None:
                places[rank] = array("i", order[lo:hi].astype(np.int32).tobytes())
        heap = list(places)
        heapify(heap)
        symbol = array("i", start.tobytes())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        whole = tuple(np.frombuffer(x, np.int32) for x in (symbol, after, before))  # the same numbers, for many places at once
        while heap:
            rank = heappop(heap)
            left, right, new = self.merges[rank]
            if len(places[rank]) >= MANY and left != right:
                for made, at in self.applied(np.sort(np.frombuffer(places.pop(rank), np.int32)), left, right, new, *whole):
                    if made in places:
                        places[made].frombytes(at)
                    else:
                        places[made] = array("i", at)
                        heappush(heap, made)
                continue
            for i in sorted(places.pop(rank)):
                j = after[i]
                if symbol[i] != left or symbol[j] != right:
                    continue  # one of the two has been merged meanwhile
                symbol[i], symbol[j] = new, GONE
                k = after[i] = after[j]
                before[k] = i
                h = before[i]
                for at, x, y in ((h, symbol[h], new), (i, new, symbol[k])):
                    if x >= 0 and y >= 0 and (made := get(x << bits | y)) is not None:
                        if made in places:
                            places[made].append(at)
                        else:
                            places[made] = array("i", [at])
                            heappush(heap, made)
        left_over = np.frombuffer(symbol, np.int32)
        left_over = left_over[left_over != GONE]
        gaps = np.flatnonzero(left_over == GAP).tolist()
        return [left_over[lo + 1 : hi].tobytes() for lo, hi in zip(gaps[:-1], gaps[1:], strict=True)]

    def applied(self, place: np.ndarray, left: int, right: int, new: int, symbol: np.ndarray, after: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Merges a pair of unlike symbols at many places; gives the ranks that the neighbours have now, and their places."""
        then = after[place]
        there = (symbol[place] == left) & (symbol[then] == right)
        there[1:] &= place[1:] != place[:-1]
        place, then = place[there], then[there]
        symbol[place], symbol[then] = new, GONE
        following = after[place] = after[then]
        before[following] = place
        preceding = before[place]
        at, x, y = np.concatenate((preceding, place)), np.concatenate((symbol[preceding], symbol[place])), np.concatenate((symbol[place], symbol[following]))
        pair = np.where((x >= 0) & (y >= 0), x.astype(np.int64) << self.bits | y, -1)
        found = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        known = self.pairs[found] == pair
        made, at = self.rank_of[found[known]], at[known]
        order = np.argsort(made, kind="stable")
        made, at = made[order], at[order]
        edges = [0, *(np.flatnonzero(made[1:] != made[:-1]) + 1).tolist(), len(made)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo < hi:
                yield int(made[lo]), at[lo:hi].tobytes()

    def long(self, word: bytes, window: int) -> bytes:
        """The ids of a word of any length, with an index over `window` bytes of it at a time."""
        out: list[np.ndarray] = []
        symbols, edge = self.window(word, 0, window)
        while edge[-1] < len(word):
            overlap = OVERLAP
            while True:
                if 2 * overlap > window:
                    return self.long(word, 2 * window)
                first = int(np.searchsorted(edge, edge[-1] - overlap))
                after, edge_after = self.window(word, int(edge[first]), window)
                # borders of both: of the one, behind a symbol; of the other, before a symbol
                _, i, j = np.intersect1d(edge[first:], edge_after[:-1], assume_unique=True, return_indices=True)
                i += first
                both = [self.raw[x] + self.raw[y] for x, y in zip(symbols[i - 1].tolist(), after[j].tolist(), strict=True)]
                want = np.column_stack((symbols[i - 1], after[j]))
                fits = [k for k, found in enumerate(self.merged(both)) if found == want[k].tobytes()]
                if fits:
                    break
                overlap *= 2
            out.append(symbols[: i[fits[0]]])
            symbols, edge = after[j[fits[0]] :], edge_after[j[fits[0]] :]
        return b"".join([*(part.tobytes() for part in out), symbols.tobytes()])

    def window(self, word: bytes, begin: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of a part of a word, and the places of their borders in the word, the first and the last one too."""
        symbols = np.frombuffer(self.merged([word[begin : begin + size]])[0], np.int32)
        return symbols, begin + np.concatenate(([0], np.cumsum(self.length[symbols])))

    def cut(self, text: str) -> Iterator[list[str]]:
        """The words of a text without special strings, PIECE characters or so at a time."""
        at = 0
        while at < len(text):
            edge = BORDER.search(text, at + PIECE)
            end = edge.start() if edge else len(text)
            piece = text[at:end]
            at = end
            if len(piece) > 2 * PIECE and ONE_WORD.fullmatch(piece):
                yield [piece]
            else:
                yield [w for w, _ in self.cutter.pre_tokenize_str(piece)] if self.beyond.search(piece) else self.words.findall(piece)

    def pieces(self, text: str | None) -> Iterator[list[str] | bytes]:
        """A text's words, and the ids of the special strings between them."""
        at = 0
        text = text or ""
        for found in self.parts.finditer(text) if self.parts else ():
            yield from self.cut(text[at : found.start()])
            yield self.special[found.group()]
            at = found.end()
        yield from self.cut(text[at:])

    def encode(self, texts: list) -> list[bytes]:
        """The ids of each whole text, as 32-bit integers."""
        out: list[list[bytes]] = []
        waiting: set[str] = set()  # words that a merge is still to come for
        open_: list[tuple[int, list[str] | bytes]] = []
        size = 0

        def settle() -> None:
            nonlocal size
            known, words = self.known, list(waiting)
            raw = [w.encode() for w in words]
            for lo, hi in chunks(list(map(len, raw)), INDEXED):
                known.update(zip(words[lo:hi], self.merged(raw[lo:hi]) if len(raw[lo]) <= INDEXED else [self.long(raw[lo], INDEXED)], strict=True))
            for i, parts in open_:
                out[i].append(parts if isinstance(parts, bytes) else b"".join(map(known.__getitem__, parts)))
            for word in words:
                if len(word) > LONGEST:
                    del known[word]
            if len(known) > REMEMBERED // 2:
                self.old, self.known = known, {}
            waiting.clear()
            open_.clear()
            size = 0

        for i, text in enumerate(texts):
            out.append([])
            for words in self.pieces(text):
                open_.append((i, words))
                if isinstance(words, bytes):
                    continue
                for word in set(words).difference(self.known):
                    if word in self.old:
                        self.known[word] = self.old[word]
                    else:
                        waiting.add(word)
                size += len(words)
                if size >= HELD:
                    settle()
        settle()
        return [b"".join(parts) for parts in out]


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One for each Python worker, with the words it remembers."""
    return Codec(path)


@lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """`docs` without its text and with n_tokens and ids, an array of the whole text's tokens.

    docs: text and any other columns; those of the names made are replaced. A null text counts as an empty one, which has no
    token. Special strings in a text are tokens of their own, as is the library's default. Texts are taken whole, however
    long, and merged in parts also where they have no white space: 50 MB of letters need 6 bytes a byte. Of one pair the
    leftmost place merges first. Rows that repeat are encoded alike; an empty table stays empty. path: the vocabulary file,
    which each executor has.
    """
    found, rest = apart(docs, "text")

    def run(texts: list) -> dict:
        parts = codec(path).encode(texts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))
        return {"n_tokens": pa.array(sizes), "ids": ids}

    return together(over_texts(found, "text", run, "n_tokens long, ids array<int>", CHUNK), rest, "n_tokens", "ids")


def decoded(rows: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """`rows` with text, what their ids stand for, and ids_sha256, of the ids as little-endian 32-bit integers.

    rows: ids and any other columns; those of the names made are replaced. Null ids give an empty text and the digest of no
    ids; ids that the vocabulary lacks give no text.
    """
    found, rest = apart(rows, "ids")
    kept = ["carried", "ids"] if keep_ids else ["carried"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(pc.list_value_length(batch.column("ids")).to_pylist()):
                part = batch.slice(lo, hi - lo)
                ids = [np.zeros(0, np.int32) if not x.is_valid else x.values.fill_null(-1).to_numpy() for x in part.column("ids")]
                texts = pa.array([decoder(path).decode(x) for x in ids], pa.string())
                digests = pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string())
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in kept} | {"text": texts, "ids_sha256": digests})

    found = found.mapInArrow(run, with_fields(found, kept, "text string, ids_sha256 string"))
    return together(found, rest, *kept[1:], "text", "ids_sha256")


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 12."""
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    found = decoded(encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path, keep_ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
