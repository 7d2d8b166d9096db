"""Quality classifier by positive-unlabelled learning.

A linear model over style features is fitted to trusted positives, unlabelled text and a class prior, by minimising the
non-negative unbiased risk of du Plessis et al. and Kiryo et al.:

    R = pi E_P[l(z)] + max(0, E_U[l(-z)] - pi E_P[l(-z)])

with the logistic loss l. No trusted negatives enter the risk. The prior pi is estimated from the share of positives
among labelled rows, or, if these are all positive, by the Elkan-Noto ratio.

All documents are the unlabelled text. Hashes of their ids and texts deal them out to blocks of bounded size, the same for
any order of the rows; each block's task minimises the risk of
the trusted positives, of which there is a bounded number, against the block, and the blocks' linear models are averaged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bytesweep import NOT_SPACE, Sweep
from quern.llm.shared import apart, fold, labelled, over_texts, together
from quern.sources.tables import table

#: Trusted positives that the classifier is fitted on at most, and unlabelled rows in a block. A block's features come to some 50 MB.
MAX_POSITIVE, BLOCK = 8_000, 16_000
THRESHOLD = 0.3

#: Kinds of bytes: lower case, upper case, digits, blanks, line ends, common punctuation, other signs, not ASCII.
KIND = np.full(256, 6, np.int64)
KIND[97:123] = 0
KIND[65:91] = 1
KIND[48:58] = 2
KIND[[9, 11, 12, 13, 32]] = 3
KIND[10] = 4
KIND[list(b".,;:'\"()-?")] = 5
KIND[128:] = 7
N_FEATURES = 512 + 6


def features(texts: list) -> np.ndarray:
    """Of each whole text: square roots of the shares of byte-kind triples, and figures of repetition and word length."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    sweep = Sweep(texts, NOT_SPACE)
    hashes, lengths = sweep.hashes(), sweep.end - sweep.start
    for i, text in enumerate(texts):
        kind = KIND[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
        if len(kind) >= 3:
            out[i, :512] = np.sqrt(np.bincount(kind[2:] + 8 * kind[1:-1] + 64 * kind[:-2], minlength=512) / (len(kind) - 2))
        words = hashes[sweep.first[i] : sweep.first[i + 1]]
        if n := len(words):
            counts = np.unique(words, return_counts=True)[1]
            again = float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0
            mean = lengths[sweep.first[i] : sweep.first[i + 1]].mean()
            out[i, 512:] = np.log1p(n) / 10, len(counts) / n, counts.max() / n, again, mean / 10, np.log1p(n / len(counts))
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The positive part of the risk, the part that should not be negative, and the gradient of each; the bias is last."""
    zp, zu = positive @ w[:-1] + w[-1], unlabelled @ w[:-1] + w[-1]
    good, bad, open_ = 1 - sigmoid(zp), sigmoid(zp), sigmoid(zu)
    of_p, of_u = np.vstack([good, bad]).astype(np.float32) @ positive / len(zp), open_.astype(np.float32) @ unlabelled / len(zu)
    of_positive = -prior * np.append(of_p[0], good.mean())
    of_negative = np.append(of_u, open_.mean()) - prior * np.append(of_p[1], bad.mean())
    soft = lambda z: float(np.logaddexp(0, z.astype(np.float64)).mean())
    return prior * soft(-zp), soft(zu) - prior * soft(zp), of_positive, of_negative


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 200, rate: float = 0.05, l2: float = 1e-4):
    """Weights and bias that Adam reaches on the non-negative risk. While the negative part is below zero its sign is turned."""
    w, m, v = (np.zeros(positive.shape[1] + 1, np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        _, negative, of_positive, of_negative = risk(positive, unlabelled, prior, w)
        grad = (of_positive + of_negative if negative >= 0 else -of_negative) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = (w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def elkan_noto(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior from a classifier of positive against unlabelled rows: its mean on all rows over its mean on positives."""
    both = len(positive) / (len(positive) + len(unlabelled))
    w = minimise(positive[::2], unlabelled, both)
    score = lambda x: sigmoid(x @ w[:-1] + w[-1])
    held = positive[1::2] if len(positive) > 1 else positive
    return float(np.clip(score(unlabelled).mean() / max(score(held).mean(), 1e-6), 0.05, 0.95))


def fitted(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> tuple[float, np.ndarray]:
    """The prior and the weights, for features as they are, of one block of unlabelled rows. Both arrays are changed in place."""
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + np.float32(1e-2)
    for x in (positive, unlabelled):
        x -= mean
        x /= scale
    prior = elkan_noto(positive, unlabelled) if prior is None else prior
    w = minimise(positive, unlabelled, prior).astype(np.float64)
    raw = w[:-1] / scale
    return prior, np.append(raw, w[-1] - raw @ mean)


class Model:
    """score(texts): from 0 to 1. Without weights every score is the prior."""

    def __init__(self, prior: float, weights: np.ndarray | None = None):
        self.prior, self.weights = prior, weights

    def score(self, texts: list) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        return sigmoid(features(texts).astype(np.float64) @ self.weights[:-1] + self.weights[-1])


def packed(docs: DataFrame) -> DataFrame:
    """(h, x) of each row of `docs`: a hash that rows are ordered by, and the features of its whole text as 16-bit floats."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    return over_texts(rows, "text", lambda texts: {"x": pa.array([f.tobytes() for f in features(texts).astype(np.float16)], pa.binary())}, "x binary")


def unpacked(x: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), np.float16).reshape(-1, N_FEATURES).astype(np.float32)


def dealt(features_of: DataFrame, blocks: int) -> DataFrame:
    """(block, h, x, n): the rows of `features_of` dealt out to blocks by their hashes, n alike in one row.

    A row that repeats has about the same number of its copies in each of the blocks, so it is nobody's burden. What a block
    holds depends on the rows alone, not on their order or partitions.
    """
    rows = features_of.groupBy("h").agg(F.count("*").alias("copies"), F.max("x").alias("x"))
    rows = rows.withColumn("pieces", F.least("copies", F.lit(blocks))).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    n = F.floor(F.col("copies") / F.col("pieces")) + (F.col("piece") < F.col("copies") % F.col("pieces")).cast("int")
    block = F.pmod(F.pmod(F.xxhash64("h", F.lit("block")), F.lit(blocks)) + F.col("piece"), F.lit(blocks))
    return rows.select(block.alias("block"), "h", "x", n.cast("long").alias("n"))


def averaged(features_of: DataFrame, positive: np.ndarray, prior: float | None, blocks: int) -> Model | None:
    """The mean of the models of all blocks, each weighed by its rows. Every row of `features_of` is in one of the blocks.

    The sums are of decimals, so that they are the same in any order.
    """
    sent = features_of.sparkSession.sparkContext.broadcast(positive.astype(np.float16))  # MAX_POSITIVE rows at most

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("h", "ascending"), ("x", "ascending")])
        n = rows.column("n").to_numpy()
        unlabelled = np.repeat(unpacked(rows.column("x")), n, axis=0)  # as many rows as a block has, repeats counted
        found, w = fitted(sent.value.astype(np.float32), unlabelled, prior)
        return pa.table({"n": [int(n.sum())], "w": [[*w, found]]})

    models = dealt(features_of, blocks).groupBy("block").applyInArrow(run, "n long, w array<double>")
    weighed = F.sum((F.col("n") * F.col("w")).cast("decimal(38,12)")) / F.sum("n")
    means = models.select("n", F.posexplode("w").alias("place", "w")).groupBy("place").agg(weighed.cast("double").alias("w"))
    w = [r.w for r in sorted(means.collect())]  # one row a feature
    sent.unpersist()
    return Model(w[-1], np.array(w[:-1])) if w else None


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, block: int = BLOCK) -> Model:
    """The model, from at most `max_positive` trusted positives, chosen by hashes of their ids, and all of `docs` as unlabelled text.

    The rows are dealt out evenly to blocks of about `block`, which their hashes choose; the risk is minimised on each, and the models are averaged.
    """
    known = labelled(labels, "quality")
    seen = known.agg(F.count("*").alias("n"), F.sum("label").alias("positive")).first()
    prior = None if not seen.n or seen.positive == seen.n else seen.positive / seen.n
    if not seen.n or not seen.positive:
        return Model(0.0 if seen.n else 0.5)
    chosen = known.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive).select("doc_id")
    # at most max_positive ids of 8 bytes each: small enough to broadcast
    positive = packed(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi"))
    positive = unpacked(positive.orderBy("h", "x").limit(max_positive).select("x").toArrow().column("x"))
    if not len(positive):
        return Model(0.5 if prior is None else prior)
    return averaged(packed(docs), positive, prior, max(1, -(-docs.count() // block)))


def quality_scores(docs: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """`docs` without its text and with `score`, the chance that a document is good.

    docs: doc_id, text and any other columns; one named score is replaced. labels: doc_id, quality. Null and empty texts
    get a score like others (all shares are 0); with no labelled row every score is 0.5, with no positive one 0. Texts are
    taken whole, however long. Rows that repeat are scored alike and each count as unlabelled; equal scores stay equal. An
    empty table stays empty. Labels are learned from folds 1 to 4 of the id only. Neither the order of the rows nor their
    partitions change a score.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, block=block))  # some 5 KB
    found, rest = apart(docs, "text")
    found = over_texts(found, "text", lambda texts: {"score": pa.array(np.round(model.value.score(texts), 9), pa.float64())}, "score double")
    return together(found, rest, "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 8."""
    scored = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
