"""Token counts by byte-pair merging with a heap and a linked list.

Each word starts as a chain of symbols. A heap holds the adjacent pairs that have a rank; the pair of the lowest rank, and
of these the leftmost, is merged again and again, and its neighbours' pairs are pushed. The count is the number of symbols
at the start less the merges; no identifiers are made. Texts are normalised and cut into words as the vocabulary's own file
says, and counts of words met before are remembered within bounds.

What counts as a letter or a number depends on the Unicode version of whoever asks. So a text of code points below U+0250,
about which all versions agree, is cut by a compiled pattern; any other is cut by the library's own cutter of the file.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from quern.llm.shared import apart, over_texts, together
from quern.sources.tables import table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Words whose counts a task remembers, and the longest such word.
REMEMBERED, LONGEST = 400_000, 64

#: The vocabulary's words end with this mark; a single letter with it is a symbol of its own.
END = "</w>"
#: Fixed values of the vocabulary file: how it cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next from U+0100 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(others)}


class Merger:
    """count(text): tokens of a whole text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocab = model["vocab"]
        # a pair of symbol numbers -> its rank and the number of what it merges to, in as many bits as the vocabulary needs
        self.bits = bits = max(vocab.values()).bit_length()
        self.pairs = {vocab[x] << bits | vocab[y]: rank << bits | vocab[x + y] for rank, (x, y) in reversed([*enumerate(model["merges"])])}
        letters = byte_letters()
        self.inner = [vocab.get(letters[b]) for b in range(256)]
        self.last = [vocab.get(letters[b] + END) for b in range(256)]
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        self.words = regex.compile(PATTERN)
        self.cutter = pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True)
        self.beyond = re.compile("[^\x00-\u024f]")
        special = [regex.escape(t["content"]) for t in file["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.counts: dict[str, int] = {}

    def merge(self, word: str) -> int:
        """Symbols that remain of a word when no ranked pair is left; letters that are in no vocabulary entry make none."""
        raw = word.encode("utf-8")
        symbol = [self.inner[b] for b in raw[:-1]]
        symbol.append(self.last[raw[-1]])
        if None in symbol:
            symbol = [s for s in symbol if s is not None]
        n = left_over = len(symbol)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        get, bits = self.pairs.get, self.bits
        low = (1 << bits) - 1
        heap = []  # rank * n + place: the lowest rank first, of these the leftmost
        for i in range(n - 1):
            if (pair := get(symbol[i] << bits | symbol[i + 1])) is not None:
                heap.append((pair >> bits) * n + i)
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), n)
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            pair = get(symbol[i] << bits | symbol[j])
            if pair is None or pair >> bits != rank:
                continue  # one of the two has been merged meanwhile
            new = symbol[i] = pair & low
            symbol[j] = -1
            left_over -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (pair := get(new << bits | symbol[k])) is not None:
                    heappush(heap, (pair >> bits) * n + i)
            h = before[i]
            if h >= 0 and (pair := get(symbol[h] << bits | new)) is not None:
                heappush(heap, (pair >> bits) * n + h)
        return left_over

    def of_word(self, word: str) -> int:
        n = self.merge(word)
        if len(word) <= LONGEST:
            if len(self.counts) >= REMEMBERED:
                self.counts.clear()
            self.counts[word] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        # what the file's normaliser does: for letters below U+0250, which do not combine, that is lower case, and words
        # are cut the same at any white space
        if self.beyond.search(text):
            words = [word for word, _ in self.cutter.pre_tokenize_str(self.normalise(text))]
        else:
            words = self.words.findall(text.lower())
        get, total = self.counts.get, 0
        for word in words:
            n = get(word)
            total += self.of_word(word) if n is None else n
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a text; each special string in it is one token, as is the library's default."""
        if not text:
            return 0
        if self.special is None or "<|" not in text:
            return self.plain(text)
        total, at = 0, 0
        for found in self.special.finditer(text):
            total += self.plain(text[at : found.start()]) + 1
            at = found.end()
        return total + self.plain(text[at:])


@lru_cache(maxsize=1)
def merger(path: str) -> Merger:
    """One for each Python worker, with the words it remembers."""
    return Merger(path)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """`docs` without its text and with n_bytes (UTF-8) and n_tokens of the whole text.

    docs: text and any other columns; those of the names made are replaced. A null text counts as an empty one, with no
    token. Texts are taken whole, however long; of equal ranks the leftmost pair merges first. Rows that repeat are counted
    alike; an empty table stays empty. path: the vocabulary file, which each executor has.
    """
    found, rest = apart(docs, "text")
    sized = found.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = over_texts(sized, "text", lambda texts: {"n_tokens": pa.array(map(merger(path).count, texts), pa.int64())}, "n_tokens long")
    return together(counted, rest, "n_bytes", "n_tokens")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 2."""
    import public_tokenizers

    found = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
