"""Exact top-k search by inner product, block at a time.

Rows are sorted into ranges of their ids; a task takes its range HELD rows at a time and numbers them anew, so that rows
with like vectors stand together: it halves them along their main direction until they are blocks. A block keeps the largest
and the smallest value of each dimension; for a query, the sum of the larger products is a bound on every score in the block.
Each query takes its blocks by falling bounds and scores whole blocks through their forward index, the block's vectors,
until the next bound falls below its k-th score so far. Queries go to the executors in chunks of bounded size; each chunk is
one pass over all rows, in which every task gives its own k best of each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.shared import owned, written
from quern.sources.tables import table

BLOCK = 256
#: Rows that a task orders at once.
HELD = 16_384
#: Queries sent to the executors at once, on average.
QUERIES = 16_384
SCALE = 256


def whole_numbers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): each component x as floor(scale * x). Vectors that are null, or have null or non-finite components, are left out."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = rows.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(~bad)
    return found.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(wide, lambda x: F.floor(scale * x).cast("long")).alias("v"))


def matrix(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """The vectors as rows, the shorter ones filled up with zeros to the widest or to `width`."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    width = max(int(sizes.max(initial=0)), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def like_together(rows: np.ndarray) -> np.ndarray:
    """An order of the rows in which each BLOCK of them is the half of a half ... along the direction in which they differ most."""
    parts, done = [np.arange(len(rows))], []
    while parts:
        part = parts.pop()
        if len(part) <= BLOCK:
            done.append(part)
            continue
        off = rows[part] - rows[part].mean(axis=0)
        way = np.ones(rows.shape[1])
        for _ in range(6):
            way = off.T @ (off @ way)
            way /= max(np.linalg.norm(way), 1e-300)
        order = part[np.argsort(off @ way, kind="stable")]
        half = BLOCK * -(-len(part) // (2 * BLOCK))
        parts += [order[half:], order[:half]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


class Search:
    """The k best rows so far of each query; seen and scored count blocks, once for each query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.scores = np.zeros((0,), np.int64)
        self.of, self.found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(len(ids), np.iinfo(np.int64).min)
        self.seen = self.scored = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Search some rows, in blocks."""
        width = max(vectors.shape[1], self.vectors.shape[1])
        rows, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (vectors, self.vectors))
        largest = max(1, int(np.abs(rows).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0))) * max(1, width)
        if largest < 1 << 53:  # products and sums are exact as doubles, which numpy multiplies faster
            rows, queries = rows.astype(np.float64), queries.astype(np.float64)
        order = like_together(rows.astype(np.float64))
        ids, rows = ids[order], rows[order]
        starts = np.arange(0, len(ids), BLOCK)
        top, bottom = np.maximum.reduceat(rows, starts, axis=0), np.minimum.reduceat(rows, starts, axis=0)
        bounds = (np.maximum(queries, 0) @ top.T + np.minimum(queries, 0) @ bottom.T).astype(np.int64)
        order = np.argsort(-bounds, axis=1, kind="stable")
        open_ = np.arange(len(queries))
        self.seen += len(queries) * len(starts)
        for turn in range(len(starts)):
            block = order[open_, turn]
            going = bounds[open_, block] >= self.least[open_]  # an equal score may have a smaller id
            open_, block = open_[going], block[going]
            if not len(open_):
                return
            self.scored += len(open_)
            new = []
            for b in np.unique(block):
                mine = open_[block == b]
                span = slice(starts[b], starts[b] + BLOCK)
                scores = (queries[mine] @ rows[span].T).astype(np.int64)
                other = ids[span][None, :] != self.ids[mine][:, None]
                ranked = np.where(other, scores, np.iinfo(np.int64).min)
                n = ranked.shape[1]
                bar = np.partition(ranked, n - self.k, axis=1)[:, n - self.k] if n > self.k else np.full(len(mine), np.iinfo(np.int64).min)
                q, at = np.nonzero(other & (scores >= np.maximum(bar, self.least[mine])[:, None]))
                new.append((mine[q], scores[q, at], ids[span][at]))
            self.keep(*(np.concatenate(x) for x in zip(*new, strict=True)))

    def keep(self, of: np.ndarray, scores: np.ndarray, found: np.ndarray) -> None:
        """Merge new rows into the k best of each query; ties go to smaller ids."""
        of, scores, found = np.concatenate((self.of, of)), np.concatenate((self.scores, scores)), np.concatenate((self.found, found))
        order = np.lexsort((found, -scores, of))
        of, scores, found = of[order], scores[order], found[order]
        first = np.searchsorted(of, of, side="left")
        place = np.arange(len(of)) - first
        best = place < self.k
        last = place == self.k - 1
        self.least[of[last]] = scores[last]
        self.of, self.scores, self.found = of[best], scores[best], found[best]


def held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of about HELD rows at a time."""
    ids, vectors, n = [], [], 0
    for batch in batches:
        ids.append(batch.column("vec_id").to_numpy())
        vectors.append(matrix(batch.column("v")))
        n += batch.num_rows
        if n >= HELD:
            yield joined(ids, vectors)
            ids, vectors, n = [], [], 0
    if n:
        yield joined(ids, vectors)


def joined(ids: list, vectors: list) -> tuple[np.ndarray, np.ndarray]:
    width = max(v.shape[1] for v in vectors)
    return np.concatenate(ids), np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in vectors])


@owned
def top_k(rows: DataFrame, is_query: str, k: int = 5, chunk: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with all rows of other ids.

    rows: vec_id, v (array of long). is_query: SQL condition on vec_id. Ties go to smaller ids; a query has fewer rows if
    there are fewer other rows. Of vectors of unlike lengths the shorter ends in zeros. Rows that repeat an id are
    candidates each, but never of a query of their id; a query that repeats is answered once for each distinct vector's
    first row. Other columns of rows are not carried. An empty table gives no rows. Scores are exact as long as they fit in 64
    bits.
    """
    rows = written(rows.repartitionByRange(F.col("vec_id"), F.xxhash64("v")).sortWithinPartitions("vec_id"))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    parts = max(1, -(-rows.where(is_query).count() // chunk))
    found = None
    for part in range(parts):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).toArrow()
        sent = rows.sparkSession.sparkContext.broadcast((mine.column("vec_id").to_numpy(), matrix(mine.column("v").combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            search = Search(*sent.value, k)
            for ids, vectors in held(batches):
                if len(search.ids):
                    search.add(ids, vectors)
            yield pa.RecordBatch.from_pydict({"query_id": search.ids[search.of], "vec_id": search.found, "score": search.scores})

        best = written(rows.mapInArrow(run, "query_id long, vec_id long, score long"), kept=True)
        sent.unpersist()
        found = best if found is None else found.union(best)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 1."""
    return top_k(whole_numbers(table(spark, sf_dir, "embeddings")), "vec_id % 50 = 0")


ORACLE_SQL = """
    WITH good AS (
        SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    v AS (SELECT vec_id, [floor(256 * x) for x in e] AS e FROM good),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
