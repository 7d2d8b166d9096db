"""Benchmark decontamination with an FM-index for each shard of training documents.

A Spark task cuts its documents into shards of bounded size, long texts too. A shard's text is the sequence of its words over the
benchmark's alphabet: a word that no benchmark item has can be in no occurrence, so it parts the sequence, and stretches
shorter than the shortest window are left out. Over what remains stands an FM-index: the suffix array's Burrows-Wheeler
transform in a wavelet matrix with rank counts, and every SAMPLE-th text position of the suffix array. The distinct
windows of the benchmark are searched backwards, all at once; occurrences are located by walking to the next sampled position; their
spans of words are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bytesweep import ALNUM, Sweep, chunks, runs
from quern.llm.shared import apart, owned, together, with_fields, written
from quern.sources.tables import table

WINDOW = 13
#: A suffix array entry is kept for every so many positions of a shard's text.
SAMPLE = 8
#: Bytes in a shard, and bytes of benchmark texts that are sent to the executors at once.
SHARD, PART_BYTES = 1 << 21, 1 << 23
#: Occurrences that are located at once.
SLICE = 1 << 18


class Phrases:
    """The distinct windows of some benchmark items, as numbers of words; 0 and 1 are for the text's end and for gaps.

    at, size: where each window stands in `number`, and its words. owners, first: the items that have window w are
    owners[first[w]:first[w + 1]].
    """

    def __init__(self, ids: list, texts: list, window: int):
        self.ids = [("" if i is None else str(i)) for i in ids]
        sweep = Sweep(texts, ALNUM)
        hashes = sweep.hashes()
        self.words = np.unique(hashes)
        self.number = np.searchsorted(self.words, hashes) + 2
        none = np.zeros(0, np.int64)
        key, at, size, item = [none.astype(np.uint64)], [none], [none], [none]
        for i, (lo, hi) in enumerate(zip(sweep.first[:-1], sweep.first[1:], strict=True)):
            if k := min(window, hi - lo):
                key.append(runs(hashes[lo:hi], k))
                at.append(np.arange(lo, hi - k + 1))
                size.append(np.full(hi - lo - k + 1, k))
                item.append(np.full(hi - lo - k + 1, i))
        key, at, size, item = (np.concatenate(x) for x in (key, at, size, item))
        _, index, of = np.unique(key, return_index=True, return_inverse=True)
        self.at, self.size = at[index], size[index]
        self.shortest = int(self.size.min(initial=1 << 62)) if len(index) else 0
        pairs = np.unique(of * max(1, len(ids)) + item)
        self.first = np.searchsorted(pairs, np.arange(len(index) + 1) * max(1, len(ids)))
        self.owners = pairs % max(1, len(ids))

    def items(self, windows: np.ndarray) -> list[str]:
        """The ids of the items that have any of the distinct windows, sorted."""
        found = np.zeros(0, np.int64)
        for lo in range(0, len(windows), 4096):
            part = [self.owners[self.first[w] : self.first[w + 1]] for w in windows[lo : lo + 4096]]
            found = np.unique(np.concatenate([found, *part]))
        return sorted({self.ids[i] for i in found})

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, or 1."""
        place = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[place] == hashes, place + 2, 1)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; the last symbol is smaller than all others."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, k = len(text), 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.cumsum(np.concatenate(([0], sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class Bits:
    """A row of bits that counts the ones before a place: 64 bits to a word, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1])).astype(np.int32)
        self.ones = int(self.before[-1]) + int(np.bitwise_count(self.words[-1]))

    def rank(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)

    def at(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class FmIndex:
    """Backward search and location in a sequence of small numbers that ends with its only 0."""

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        symbols = text[order - 1].astype(np.int32)
        self.levels = max(1, int(text.max()).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):  # a wavelet matrix: each level's bits, then zeros before ones
            bit = (symbols >> level) & 1 == 1
            self.ones.append(Bits(bit))
            self.zeros.append(len(bit) - self.ones[-1].ones)
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << self.levels))))
        sampled = order % SAMPLE == 0
        self.sampled = Bits(sampled)
        self.sample = order[sampled].astype(np.int32)
        self.size = len(text)

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place in the transform."""
        low = np.zeros_like(place)
        for ones, zeros, level in zip(self.ones, self.zeros, range(self.levels - 1, -1, -1), strict=True):
            bit = (symbol >> level) & 1 == 1
            low, place = (np.where(bit, zeros + r, x - r) for x, r in ((x, ones.rank(x)) for x in (low, place)))
        return place - low

    def symbol(self, place: np.ndarray) -> np.ndarray:
        """What stands at the place of the transform."""
        out = np.zeros_like(place)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit, r = ones.at(place), ones.rank(place)
            out = 2 * out + bit
            place = np.where(bit == 1, zeros + r, place - r)
        return out

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows that occur, and their ranges of suffixes."""
        alive = np.arange(len(phrases.at))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.size)
        out = []
        for back in range(1, int(phrases.size.max(initial=0)) + 1):
            symbol = phrases.number[phrases.at[alive] + phrases.size[alive] - back]
            known = symbol < len(self.smaller) - 1
            alive, low, high, symbol = alive[known], low[known], high[known], symbol[known]
            low, high = (self.smaller[symbol] + self.rank(symbol, x) for x in (low, high))
            left = low < high
            alive, low, high = alive[left], low[left], high[left]
            done = phrases.size[alive] == back
            out.append((alive[done], low[done], high[done]))
            alive, low, high = alive[~done], low[~done], high[~done]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (alive, low, high)

    def locate(self, place: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps towards the front until a sampled one."""
        out, steps, open_ = np.zeros_like(place), 0, np.arange(len(place))
        while len(open_):
            found = self.sampled.at(place) == 1
            out[open_[found]] = self.sample[self.sampled.rank(place[found])] + steps
            open_, place = open_[~found], place[~found]
            symbol = self.symbol(place)
            place = self.smaller[symbol] + self.rank(symbol, place)
            steps += 1
        return out


def shard_hits(sweep: Sweep, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, first word) of every occurrence of a benchmark window in the texts of a shard, in slices of SLICE at most.

    At one place of a text there is one window of a size at most, however often items repeat it.
    """
    if not phrases.shortest or not len(sweep.start):
        return
    number = phrases.numbers(sweep.hashes())
    known = number > 1
    # stretches of known words of one text
    begins = np.zeros(len(known), bool)
    begins[sweep.first[:-1][sweep.words > 0]] = True
    begins |= np.concatenate(([True], ~known[:-1]))
    first = np.flatnonzero(known & begins)
    ends = np.flatnonzero(known & np.concatenate((begins[1:] | ~known[1:], [True]))) + 1
    long = ends - first >= phrases.shortest
    first, ends = first[long], ends[long]
    if not len(first):
        return
    size = ends - first + 1  # with a gap behind each
    offset = np.concatenate(([0], np.cumsum(size)))
    text = np.ones(offset[-1] + 1, np.int64)
    word = np.repeat(first - offset[:-1], size) + np.arange(offset[-1])
    gap = np.zeros(offset[-1], bool)
    gap[offset[1:] - 1] = True
    text[:-1][~gap] = number[word[~gap]]
    text[-1] = 0
    index = FmIndex(text)
    window, low, high = index.search(phrases)
    upto = np.concatenate(([0], np.cumsum(high - low)))
    for lo in range(0, int(upto[-1]), SLICE):
        place = np.arange(lo, min(lo + SLICE, int(upto[-1])))
        which = np.searchsorted(upto, place, side="right") - 1
        yield window[which], word[index.locate(low[which] + place - upto[which])]


def hit_words(sweep: Sweep, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word whether it is hit; the distinct pairs of a text and a window that occurs in it."""
    edge = np.zeros(len(sweep.start) + 1, np.int32)
    many = max(1, len(phrases.at))
    pairs = np.zeros(0, np.int64)
    for window, at in shard_hits(sweep, phrases):
        np.add.at(edge, at, 1)
        np.add.at(edge, at + phrases.size[window], -1)
        owner = np.searchsorted(sweep.first, at, side="right") - 1
        pairs = np.union1d(pairs, owner * many + window)
    return np.cumsum(edge)[:-1] > 0, pairs // many, pairs % many


def spans_of(hit: np.ndarray) -> list[list[int]]:
    """The runs of hit words, as [from, to)."""
    turn = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return turn.reshape(-1, 2).tolist()


def merged(spans: list[list[int]]) -> list[list[int]]:
    """The union of spans, those that touch joined."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def hits(texts: list, phrases: Phrases) -> tuple[list, list, list]:
    """Of each text its number of words, the ids of the items found, and the merged spans [from, to) of hit words."""
    sweep = Sweep(texts, ALNUM)
    hit, owner, window = hit_words(sweep, phrases)
    items = [phrases.items(window[lo:hi]) for lo, hi in (np.searchsorted(owner, [i, i + 1]) for i in range(len(texts)))]
    return sweep.words.tolist(), items, [spans_of(hit[lo:hi]) for lo, hi in zip(sweep.first[:-1], sweep.first[1:], strict=True)]


def border(text: np.ndarray, at: int) -> int:
    """The first place from `at` on that is in no word."""
    while at < len(text):
        apart = np.flatnonzero(~ALNUM[text[at : at + 65_536]])
        if len(apart):
            return at + int(apart[0])
        at += 65_536
    return len(text)


def hits_of_long(text: np.ndarray, phrases: Phrases, shard: int) -> tuple[list, list, list]:
    """What hits() gives for one text, the UTF-8 bytes `text`, which is cut into shards of about `shard` bytes.

    A shard ends between words, and the next one begins with its last words, one fewer than the longest window has; so
    each occurrence lies whole in one shard, and those that lie in two make the same spans.
    """
    overlap = max(0, int(phrases.size.max(initial=0)) - 1)
    begin, at, before = 0, 0, 0  # a shard's first byte, its first new byte, the words in front of it
    spans: list[list[int]] = []
    windows = np.zeros(0, np.int64)
    while True:
        end = border(text, at + shard)
        sweep = Sweep([text[begin:end].tobytes()], ALNUM)
        hit, _, window = hit_words(sweep, phrases)
        spans += [[before + lo, before + hi] for lo, hi in spans_of(hit)]
        windows = np.union1d(windows, window)
        n = len(sweep.start)
        if end >= len(text):
            return [before + n], [phrases.items(windows)], [merged(spans)]
        again = min(overlap, n)
        before += n - again
        begin, at = (begin + int(sweep.start[n - again]) - 1 if again else end), end


@owned
def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES, shard: int = SHARD) -> DataFrame:
    """`docs` without its text and with n_words, n_hit, items (ids as text, sorted), spans (arrays [from, to) of words).

    docs: text and any other columns; those of the names made are replaced. benchmark: item_id, text. Null and empty texts
    have no words and no hits; an item without words has no window; a null item_id is the empty text. Items of one id count
    once; a window that several items have counts for each of them. Texts are taken whole, however long; one of more than
    `shard` bytes is in several shards, which overlap. Rows that repeat are treated alike; an empty benchmark gives no hits, an empty table stays empty. The benchmark goes to the executors in
    parts of about `part_bytes`; beyond one part the documents are passed once for each.
    """
    items = benchmark.select("item_id", "text").where(F.length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = max(1, -(-total // part_bytes))
    found, rest = apart(docs, "text")
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toArrow()
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), window))
        if part:
            found = written(found, kept=part == parts - 1)
            sent.unpersist()
        sent = phrases

        # the text goes on only where another part follows
        kept = ["carried", "text"] if part < parts - 1 else ["carried"]

        def run(batches, phrases=phrases, later=part > 0, kept=kept):
            for batch in batches:
                sizes = pc.binary_length(batch.column("text")).to_pylist()
                for lo, hi in chunks(sizes, shard):
                    b = batch.slice(lo, hi - lo)
                    if (sizes[lo] or 0) > shard:
                        n_words, items, spans = hits_of_long(np.frombuffer(b.column("text")[0].as_buffer(), np.uint8), phrases.value, shard)
                    else:
                        n_words, items, spans = hits(b.column("text").to_pylist(), phrases.value)
                    if later:
                        items = [sorted({*x, *y}) for x, y in zip(items, b.column("items").to_pylist(), strict=True)]
                        spans = [merged(x + y) for x, y in zip(spans, b.column("spans").to_pylist(), strict=True)]
                    out = {c: b.column(c) for c in kept}
                    yield pa.RecordBatch.from_pydict(out | {"n_words": pa.array(n_words, pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))})

        found = found.mapInArrow(run, with_fields(found, kept, "n_words long, items array<string>, spans array<array<long>>"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return together(found.withColumn("n_hit", n_hit), rest, "n_words", "n_hit", "items", "spans")


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 4."""
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), is_contaminated().alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    item_windows AS (
        SELECT DISTINCT item_id, least(13, len(w)) AS k, unnest([array_to_string(w[i:i + least(13, len(w)) - 1], ' ')
            for i in range(1, len(w) - least(13, len(w)) + 2)]) AS s
        FROM b WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT k FROM item_windows),
    places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k),
    doc_windows AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM places),
    found AS (SELECT doc_id, i, item_id, x.k FROM doc_windows x JOIN item_windows y ON x.k = y.k AND x.s = y.s),
    n_hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
    items AS (
        SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN n_hits USING (doc_id) LEFT JOIN items USING (doc_id)"""
