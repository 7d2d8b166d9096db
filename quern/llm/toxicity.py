"""Toxicity by class-conditional Kneser-Ney models.

Two models of the letters of words, one of toxic and one of ordinary labelled texts, are n-gram models of order 5 over
bytes within words. Their highest order has the counts of its own class, with absolute discounting; all lower orders are
Kneser-Ney continuation counts that both classes share. So a rare expression that neither class has seen costs the same
in both and leaves the comparison alone, while inflected forms of a toxic stem still meet the stem's n-grams.

The counts are exact, over all labelled rows that may be learned from, and are aggregated by Spark. A logistic curve
fitted on a fold of its own, with counts that leave this fold out, turns three figures of a text into a score: the
length-normalised difference of the two log-likelihoods, the summed differences of its clearly toxic words over the root
of its words, and the largest difference of one word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bytesweep import LETTERS, Sweep, chunks
from quern.llm.shared import apart, fold, labelled, over_texts, owned, together, with_fields, written
from quern.sources.tables import table

ORDER = 5
DISCOUNT = 0.75
#: Rows that the logistic curve is fitted on at most.
MAX_CALIBRATION = 20_000
#: A word counts as clearly toxic above this difference of log-likelihoods.
CLEAR = 4.0
#: N-grams whose values are broadcast at most, 12 bytes each; beyond, chunks of texts ask for the values of their n-grams.
MAX_BROADCAST = 4_000_000
#: Then: bytes of texts in a chunk, n-grams in a range of the tables, and chunks that one copy of a range answers.
CHUNK, RANGE, ASKED = 1 << 22, 1 << 20, 256
#: Level of compression of packed texts, which are on disk twice, as a table and in a shuffle.
LEVEL = 5
FIGURES = "x0 double, x1 double, x2 double"


def grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Of each letter and word end its n-gram, one byte a place, and the text it is in.

    The stream has a 0 before each word and at its end; contexts stop at the word's beginning.
    """
    sweep = Sweep([t.lower() if t else "" for t in texts], LETTERS)
    inside = LETTERS[sweep.data]
    kept = inside | np.concatenate(([False], inside[:-1]))
    stream = np.where(inside, sweep.data, 0).astype(np.uint64)[kept]
    owner = np.repeat(np.arange(len(sweep)), np.diff(np.searchsorted(np.flatnonzero(kept), sweep.offset)))
    n = len(stream)
    place = np.arange(n)
    ends = np.maximum.accumulate(np.where(stream == 0, place, -1)) if n else place
    before = np.concatenate(([-1], ends[:-1])) if n else place
    out = np.zeros(n, np.uint64)
    for back in range(min(ORDER - 1, max(n - 1, 0)), -1, -1):
        earlier = np.concatenate((np.zeros(back, np.uint64), stream[: n - back]))
        out = (out << np.uint64(8)) | np.where(place - back >= before, earlier, 0)
    return out, owner


def counts(texts: DataFrame) -> DataFrame:
    """(gram, late, n1, n0): how often each n-gram occurs in texts labelled 1 and 0. texts: text, label, late, true where the curve is fitted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts, label = batch.column("text"), batch.column("label").to_numpy()
            is_late = batch.column("late").to_numpy(zero_copy_only=False).astype(np.uint64)
            keys, ones, zeros = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for lo, hi in chunks(pc.binary_length(all_texts).to_pylist()):
                gram, owner = grams(all_texts[lo:hi].to_pylist())
                is_one = label[lo:hi][owner] == 1
                gram = gram | is_late[lo:hi][owner] << np.uint64(8 * ORDER)  # above the n-gram's own bits
                merged, at = np.unique(np.concatenate((keys, gram)), return_inverse=True)
                weigh = lambda old, new: np.bincount(at, np.concatenate((old, new)), len(merged)).astype(np.int64)  # noqa: B023, E731
                keys, ones, zeros = merged, weigh(ones, is_one), weigh(zeros, ~is_one)
            late = keys >> np.uint64(8 * ORDER) > 0
            gram = keys & np.uint64((1 << 8 * ORDER) - 1)
            yield pa.RecordBatch.from_pydict({"gram": gram.astype(np.int64), "late": late, "n1": ones, "n0": zeros})

    made = texts.select("text", "label", "late").mapInArrow(run, "gram long, late boolean, n1 long, n0 long")
    return made.groupBy("gram", "late").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def discounted(count, total, types, lower):
    """The interpolated estimate; the lower order alone where the context is new."""
    return F.when(total > 0, (F.greatest(count - DISCOUNT, F.lit(0.0)) + DISCOUNT * types * lower) / total).otherwise(lower)


def tables_of(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, llr) of n-grams seen, (context, llr) of their contexts followed by something new."""
    levels = {ORDER: counted.select("gram")}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different letters stand before it
        levels[k] = levels[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(F.count("*").alias("n"))
    shared = None
    for k in range(1, ORDER):
        level = levels[k].withColumn("context", F.shiftright("gram", 8))
        contexts = level.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        level = level.join(contexts, "context").withColumn("below", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
        level = level.withColumn("lower", F.lit(1 / 256)) if shared is None else level.join(shared, "below")
        shared = level.select(F.col("gram").alias("below"), discounted(F.col("n"), F.col("total"), F.col("types"), F.col("lower")).alias("lower"))
    top = counted.withColumn("context", F.shiftright("gram", 8)).withColumn("below", F.col("gram").bitwiseAND(F.lit((1 << 8 * (ORDER - 1)) - 1)))
    contexts = top.groupBy("context").agg(*[f(c) for c in ("n1", "n0") for f in (lambda c: F.sum(c).alias(f"total_{c}"), lambda c: F.sum((F.col(c) > 0).cast("int")).alias(f"types_{c}"))])
    top = top.join(contexts, "context").join(shared, "below")
    p1, p0 = (discounted(F.col(c), F.col(f"total_{c}"), F.col(f"types_{c}"), F.col("lower")) for c in ("n1", "n0"))
    left1, left0 = (F.when(F.col(f"total_{c}") > 0, DISCOUNT * F.col(f"types_{c}") / F.col(f"total_{c}")).otherwise(1.0) for c in ("n1", "n0"))
    return top.select("gram", F.log(p1 / p0).alias("llr")), contexts.select(F.col("context").alias("gram"), F.log(left1 / left0).alias("llr"))


def keyed(llr: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram of `llr`, in order, and its value: as many as were counted, each under its own whole key."""
    found = llr.select("gram", F.col("llr").cast("float")).toArrow()
    gram, value = found.column("gram").to_numpy().astype(np.uint64), found.column("llr").to_numpy()
    order = np.argsort(gram)
    return gram[order], value[order]


def looked_up(gram: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The n-grams' values; a NaN where the keys, which are in order, lack one."""
    if not len(keys):
        return np.full(len(gram), np.nan, np.float32)
    at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
    return np.where(keys[at] == gram, values[at], np.float32(np.nan))


def figures(texts: list, seen: tuple, new: tuple) -> np.ndarray:
    """Of each text: the mean difference a letter, the clearly toxic words' over the root of the words, the largest of a word."""
    gram, owner = grams(texts)
    out = np.zeros((len(texts), 3))
    if not len(gram):
        return out
    llr = looked_up(gram, *seen)
    unseen = np.isnan(llr)
    llr[unseen] = looked_up(gram[unseen] >> np.uint64(8), *new)
    llr = np.nan_to_num(llr).astype(np.float64)
    letters = np.bincount(owner, minlength=len(texts))
    ends = np.flatnonzero((gram & np.uint64(255)) == 0)
    word = np.diff(np.concatenate(([0.0], np.cumsum(llr)[ends])))
    words = np.bincount(owner[ends], minlength=len(texts))
    out[:, 0] = np.bincount(owner, llr, len(texts)) / np.maximum(letters, 1)
    out[:, 1] = np.bincount(owner[ends], np.maximum(word - CLEAR, 0), len(texts)) / np.sqrt(np.maximum(words, 1))
    largest = np.full(len(texts), -np.inf)
    np.maximum.at(largest, owner[ends], word)
    out[:, 2] = np.where(words > 0, largest, 0)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights, the bias first, of a logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    hold = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + hold, x.T @ (y - p) - hold @ w)
    return w


def shut(column: pa.Array, level: int = 1) -> bytes:
    """A column in few bytes, for opened()."""
    batch = pa.record_batch([column], names=["x"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(data: bytes) -> pa.ChunkedArray:
    return pa.ipc.open_stream(data).read_all().column(0)


def packed_chunks(df: DataFrame, limit: int) -> DataFrame:
    """(chunk, held, texts): a row for about `limit` bytes of texts of one task; held has the other columns. To be written: another run may cut elsewhere."""
    others = [c for c in df.columns if c != "text"]
    fields = with_fields(df.select(F.array(F.struct(*others)).alias("held")), ["held"], "chunk long, texts binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi in chunks(pc.binary_length(batch.column("text")).to_pylist(), limit):
                part = batch.slice(lo, hi - lo)
                rows = pa.StructArray.from_arrays([part.column(c) for c in others], names=others)
                held = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
                yield pa.RecordBatch.from_pydict({"held": held, "chunk": pa.array([chunk], pa.int64()), "texts": pa.array([shut(part.column("text"), LEVEL)], pa.binary())})
                chunk += 1

    return df.select(*others, "text").mapInArrow(run, fields)


def ranged(texts: list, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a chunk's texts, in order, and the range of the tables that each is in."""
    gram = np.unique(grams(texts)[0])
    return gram, (gram >> np.uint64(8)) % np.uint64(ranges)


def asked_grams(rows: DataFrame, ranges: int) -> DataFrame:
    """(range, chunk, grams) of the distinct n-grams of each chunk: steps from one to the next, packed, for each range that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts in zip(batch.column("chunk").to_pylist(), batch.column("texts"), strict=True):
                gram, of = ranged(opened(texts.as_buffer()).to_pylist(), ranges)
                for r in np.unique(of).tolist():
                    steps = np.diff(gram[of == r], prepend=np.uint64(0))
                    yield pa.RecordBatch.from_pydict({"range": [r], "chunk": [chunk], "grams": pa.array([shut(pa.array(steps))], pa.binary())})

    return rows.select("chunk", "texts").mapInArrow(run, "range long, chunk long, grams binary")


def ungapped(data: bytes) -> np.ndarray:
    return np.cumsum(opened(data).to_numpy())


def packed_tables(seen: DataFrame, new: DataFrame, ranges: int) -> DataFrame:
    """(range, keys, values, contexts, lefts): the n-grams of each range of contexts in order with their values, and its contexts with theirs."""
    both = seen.select(F.pmod(F.shiftright("gram", 8), F.lit(ranges)).alias("range"), F.lit(True).alias("whole"), "gram", F.col("llr").cast("float").alias("llr"))
    both = both.union(new.select(F.pmod("gram", F.lit(ranges)).alias("range"), F.lit(False), "gram", F.col("llr").cast("float")))

    def run(rows: pa.Table) -> pa.Table:
        out = {"range": pa.array([rows.column("range")[0].as_py()], pa.int64())}
        for names, kind in ((("keys", "values"), True), (("contexts", "lefts"), False)):
            mine = rows.filter(pc.equal(rows.column("whole"), kind)).sort_by("gram")
            out |= {names[0]: pa.array([mine.column("gram").to_numpy().tobytes()]), names[1]: pa.array([mine.column("llr").to_numpy().tobytes()])}
        return pa.table(out)

    return both.groupBy("range").applyInArrow(run, "range long, keys binary, values binary, contexts binary, lefts binary")


def answered(asked: DataFrame, tables: DataFrame, salts: int) -> DataFrame:
    """(chunk, range, values): the values of what is asked, in its order, NaN where there is none.

    A range's tables come first where its requests come together, and are kept while these pass. They are in so many copies
    that no task has all requests of a range.
    """
    blank = F.lit(None).cast("binary")
    left = tables.select("range", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).cast("long").alias("chunk"), "keys", "values", "contexts", "lefts", blank.alias("grams"))
    right = asked.select("range", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int"), "chunk", blank, blank, blank, blank, "grams")
    together_ = left.union(right).repartition("range", "salt").sortWithinPartitions("range", "salt", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, kept = None, ()
        for batch in batches:
            chunk, of = batch.column("chunk").to_pylist(), batch.column("range").to_pylist()
            for i in range(batch.num_rows):
                if chunk[i] < 0:
                    kinds = {"keys": np.uint64, "values": np.float32, "contexts": np.uint64, "lefts": np.float32}
                    here, kept = of[i], tuple(np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in kinds.items())
                    continue
                gram = ungapped(batch.column("grams")[i].as_py())
                value = np.full(len(gram), np.nan, np.float32)
                if here == of[i]:
                    value = looked_up(gram, *kept[:2])
                    unseen = np.isnan(value)
                    value[unseen] = looked_up(gram[unseen] >> np.uint64(8), *kept[2:])
                yield pa.RecordBatch.from_pydict({"chunk": [chunk[i]], "range": [of[i]], "values": pa.array([value.tobytes()], pa.binary())})

    return together_.drop("salt").mapInArrow(run, "chunk long, range long, values binary")


def joined_figures(df: DataFrame, seen: DataFrame, new: DataFrame, limit: int = CHUNK, kept: bool = False, in_range: int = RANGE) -> DataFrame:
    """What over_texts() with figures() gives, with tables of any size: each chunk of texts meets the values of its own n-grams.

    A chunk asks once for each of its n-grams, packed by ranges of these; a range's tables fit in a task. What is shuffled
    is the packed texts, once, and the requests and answers, which are small against them. Answers are bare values: a chunk
    finds its n-grams again in the order in which it asked.
    """
    others = [c for c in df.columns if c != "text"]
    rows = written(packed_chunks(df, limit), kept)
    ranges = max(1, -(-seen.count() // in_range)) | 1  # an odd number, since contexts of one last letter differ by 256
    salts = max(1, -(-rows.count() // ASKED))
    replies = answered(asked_grams(rows, ranges), packed_tables(seen, new, ranges), salts)
    got = replies.groupBy("chunk").agg(F.collect_list(F.struct("range", "values")).alias("got"))  # one for each range at most
    joined = rows.join(got.hint("merge"), "chunk", "left").select("held", "texts", "got")
    none = (np.zeros(0, np.uint64), np.zeros(0, np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts = opened(batch.column("texts")[i].as_buffer()).to_pylist()
                gram, of = ranged(texts, ranges)
                value = np.full(len(gram), np.nan, np.float32)
                for part in batch.column("got")[i].as_py() or []:
                    value[of == part["range"]] = np.frombuffer(part["values"], np.float32)
                x = figures(texts, (gram, value), none)
                held = batch.column("held")[i].values
                yield pa.RecordBatch.from_pydict({c: held.field(c) for c in others} | {f"x{k}": pa.array(x[:, k], pa.float64()) for k in range(3)})

    return joined.mapInArrow(run, with_fields(df, others, FIGURES))


@owned
def toxicity_scores(docs: DataFrame, labels: DataFrame, most_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """`docs` without its text and with `score`, the chance that a document is toxic, and `llr`, the difference a letter.

    docs: doc_id, text and any other columns; those named score or llr are replaced. labels: doc_id, toxic. The logistic
    curve is fitted on fold 4 of the ids with counts of folds 1 to 3 (or on these folds, if fold 4 lacks a class); the
    counts that scores come from are of folds 1 to 4. Fold 0 is never learned from.

    Tables of more than `most_broadcast` n-grams are not broadcast but joined, with the same scores. Null and empty texts
    have figures of 0 and the score that follows from these. Where labelled rows lack a class, every score is the share
    of that class. Texts are taken whole, however long; equal figures give equal scores. Rows that repeat are scored alike;
    an empty table stays empty.
    """
    known = written(labelled(labels, "toxic"))
    seen = known.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    if not seen.n or not seen.toxic or seen.toxic == seen.n:
        share = float((seen.toxic or 0) / max(seen.n, 1))
        found, rest = apart(docs, "text")
        return together(found.withColumn("score", F.lit(share)).withColumn("llr", F.lit(0.0)), rest, "score", "llr")
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).where(F.col("text").isNotNull())
    # labels grow with the documents, so they are not broadcast, however small they are
    learned = known.select("doc_id", "label", (F.col("fold") == 4).alias("late"))
    counted = written(counts(texts.where(fold() > 0).join(learned.hint("merge"), "doc_id")))
    in_all = counted.groupBy("gram").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    early = counted.where("not late").drop("late")

    def measurer(of: DataFrame, kept: bool = False) -> Callable[[DataFrame], DataFrame]:
        """Gives texts their figures by the counts `of`; by a broadcast if there are few n-grams, else by a join, to the same result."""
        seen, new = tables_of(of)
        if of.count() > most_broadcast:  # as many n-grams as `seen` has rows, and no fewer than `new` has
            seen, new = written(seen, kept), written(new, kept)
            return lambda df: joined_figures(df, seen, new, kept=kept)
        tables = docs.sparkSession.sparkContext.broadcast([keyed(t) for t in (seen, new)])

        def run(texts: list) -> dict:
            found = figures(texts, *tables.value)
            return {f"x{k}": pa.array(found[:, k], pa.float64()) for k in range(3)}

        return lambda df: over_texts(df, "text", run, FIGURES)

    measured = measurer(early)  # the curve's fold is not in the counts that the curve is fitted on

    def sample(where: str) -> tuple[np.ndarray, np.ndarray]:
        # at most MAX_CALIBRATION ids and labels of some 16 bytes: small enough to broadcast
        chosen = known.where(where).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_CALIBRATION).select("doc_id", "label")
        # where ids repeat there are more rows than ids; their hashes say which are taken
        rows = measured(texts.join(F.broadcast(chosen), "doc_id")).orderBy("h", "doc_id").limit(MAX_CALIBRATION).toArrow()
        return np.column_stack([rows.column(f"x{k}").to_numpy() for k in range(3)]), rows.column("label").to_numpy()

    x, y = sample("fold = 4")
    if not 0 < y.sum() < len(y):
        x, y = sample("fold <= 3")
    if not 0 < y.sum() < len(y):
        x, y = np.zeros((2, 3)), np.array([0, 1])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    w = logistic((x - mean) / scale, y)
    w[1:] /= scale
    w[0] -= float(w[1:] @ mean)
    score = F.lit(float(w[0])) + sum(F.lit(float(w[k + 1])) * F.col(f"x{k}") for k in range(3))
    found, rest = apart(docs, "text")
    made = measurer(in_all, kept=True)(found)
    made = made.select("carried", F.round(1 / (1 + F.exp(-score)), 9).alias("score"), F.col("x0").alias("llr"))
    return together(made, rest, "score", "llr")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 3."""
    scored = toxicity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "llr")
