"""Vector code compression by filtering Lloyd.

Vectors of whole numbers are cut into PARTS equal consecutive parts; each part position has a codebook, which Lloyd's rounds
improve. A task takes its vectors in blocks and builds, for each part position, a kd-tree over the block's parts; a node keeps
the bounding box, the sum and the count of what it holds. The trees are written once and serve all rounds.

In a round the entries go down each tree together. In a node's box the entry nearest to its middle is compared with every
other one at the corner that is best for the other; an entry that loses even there is eliminated for the whole subtree. Where
one entry is left, the subtree is assigned at once by its sum and count. Only in leaves with several entries left are parts
looked at one by one. All comparisons are exact, ties go to the lower index. Tasks send on sums and counts of entries only,
so that a round shuffles the same few rows for each task, whatever it holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import apart, owned, settled, together, with_fields, written
from quern.llm.topk import matrix
from quern.sources.tables import table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components in a block of vectors, and parts in a leaf.
BLOCK, LEAF = 1 << 19, 24
#: Labels whose sums are broadcast at most, some 24 bytes each; beyond, they meet their rows in a join of salted keys.
MAX_BROADCAST, SALTS = 100_000, 16
TREE = "points array<binary>, place array<binary>, low array<binary>, high array<binary>, total array<binary>, span array<binary>"


def bound(width: int) -> int:
    """Components are held between this and its negative, beyond which squared distances might not fit a long."""
    return int((1 << 29) / max(1.0, width / PARTS) ** 0.5)


def whole_numbers(rows: DataFrame, scale: int) -> DataFrame:
    """`rows` with each component x of embedding as floor(scale * x), in v; those with null or non-finite vectors are left out."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = F.transform(wide, lambda x: F.floor(F.greatest(F.least(scale * x, F.lit(float(1 << 30))), F.lit(-float(1 << 30)))).cast("long"))
    return rows.where(F.col("embedding").isNotNull()).where(~bad).withColumn("v", held).drop("embedding")


class Tree:
    """A kd-tree over points, which it keeps in its own order.

    place: where each point was. low, high, total: of each node its box and sum. span: of each node its first point, the
    one behind its last, and its two children, or 0 for a leaf. Points that are all alike are a leaf, however many.
    """

    def __init__(self, points: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray, span: np.ndarray):
        self.points, self.place, self.low, self.high, self.total, self.span = points, place, low, high, total, span

    @classmethod
    def of(cls, points: np.ndarray) -> Tree:
        place = np.arange(len(points))
        low, high, total, span = [], [], [], []
        open_ = [(0, len(points), -1, 0)]
        while open_:
            lo, hi, above, side = open_.pop()
            held = points[place[lo:hi]]
            least, most = held.min(axis=0), held.max(axis=0)
            if above >= 0:
                span[above][side] = len(span)
            low.append(least)
            high.append(most)
            total.append(held.sum(axis=0))
            span.append([lo, hi, 0, 0])
            width = most - least
            if hi - lo > LEAF and width.any():
                middle = (hi - lo) // 2
                place[lo:hi] = place[lo:hi][np.argpartition(held[:, width.argmax()], middle)]
                open_ += [(lo + middle, hi, len(span) - 1, 3), (lo, lo + middle, len(span) - 1, 2)]
        return cls(points[place], place, *(np.array(x, np.int64) for x in (low, high, total, span)))

    def packed(self) -> list[bytes]:
        kinds = (np.int32, np.int32, np.int32, np.int32, np.int64, np.int32)
        parts = (self.points, self.place, self.low, self.high, self.total, self.span)
        return [x.astype(k).tobytes() for x, k in zip(parts, kinds, strict=True)]

    @classmethod
    def unpacked(cls, parts: list[bytes], width: int) -> Tree:
        points, place, low, high, total, span = (np.frombuffer(x, k) for x, k in zip(parts, (np.int32,) * 4 + (np.int64, np.int32), strict=True))
        span = span.reshape(-1, 4)
        return cls(*(x.reshape(n, width) if n is not None else x for x, n in ((points, len(place)), (place, None), (low, len(span)), (high, len(span)), (total, len(span)))), span)

    def filtered(self, book: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
        """(from, to, node, entries): points of one subtree with the one entry of all of them, or of a leaf with one for each.

        A subtree's entry comes with its node, so that its sum can be used; a leaf's entries with -1.
        """
        most = max(int(np.abs(x).max(initial=0)) for x in (book, self.low, self.high))
        kind = np.float64 if 16 * book.shape[1] * most * most < 1 << 53 else np.int64  # both exact; floats are faster
        book = book.astype(kind)
        square = (book * book).sum(axis=1)
        node, left = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
        large = np.inf if kind is np.float64 else np.iinfo(np.int64).max
        index = np.arange(len(book))
        while len(node):
            low, high = self.low[node].astype(kind), self.high[node].astype(kind)
            off = square - (low + high) @ book.T  # the squared distance to the middle, less what all entries share
            best = np.where(left, off, large).argmin(axis=1)
            for b in np.unique(best):
                at = np.flatnonzero(best == b)
                # how much farther than entry b each entry is, at the corner that is best for it
                farther = off[at] - off[at, b, None] - (high[at] - low[at]) @ np.abs(book - book[b]).T
                left[at] &= (farther < 0) | ((farther == 0) & (index < b)) | (index == b)
            alone = left.sum(axis=1) == 1
            for i in np.flatnonzero(alone):
                yield *self.span[node[i], :2], int(node[i]), best[i : i + 1]
            leaf = ~alone & (self.span[node, 2] == 0)
            for i in np.flatnonzero(leaf):
                lo, hi = self.span[node[i], :2]
                some = np.flatnonzero(left[i])
                yield lo, hi, -1, some[(square[some] - 2 * (self.points[lo:hi].astype(kind) @ book[some].T)).argmin(axis=1)]
            inner = np.flatnonzero(~alone & ~leaf)
            node, left = self.span[node[inner], 2:].ravel(), np.repeat(left[inner], 2, axis=0)

    def add_to(self, book: np.ndarray, total: np.ndarray, count: np.ndarray) -> None:
        """Adds the sum and the count of the points of each entry."""
        for lo, hi, node, entry in self.filtered(book):
            if node >= 0:
                total[entry[0]] += self.total[node]
                count[entry[0]] += hi - lo
            else:
                np.add.at(total, entry, self.points[lo:hi])
                np.add.at(count, entry, 1)

    def assigned(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each point and its squared distance, in the points' first order."""
        entry = np.zeros(len(self.points), np.int64)
        for lo, hi, _, found in self.filtered(book):
            entry[self.place[lo:hi]] = found
        points = np.empty(self.points.shape, np.int64)
        points[self.place] = self.points
        return entry, ((points - book[entry]) ** 2).sum(axis=1)


def in_blocks(rows: DataFrame, width: int, block: int) -> DataFrame:
    """A row for each block of about `block` components: `held`, its rows but for v, and the trees of its parts. rows: carried, v."""
    most, size, edge = max(1, block // max(1, width)), width // PARTS, bound(width)
    fields = with_fields(rows.select(F.array("carried").alias("held")), ["held"], TREE)

    def made(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks()
        v = np.clip(matrix(whole.column("v").combine_chunks(), width), -edge, edge)
        trees = [Tree.of(v[:, p * size : (p + 1) * size]).packed() for p in range(PARTS)]
        carried = whole.column("carried").combine_chunks()
        held = pa.ListArray.from_arrays(pa.array([0, len(carried)], pa.int32()), carried)
        names = ("points", "place", "low", "high", "total", "span")
        return pa.RecordBatch.from_pydict({"held": held} | {c: pa.array([[t[i] for t in trees]], pa.list_(pa.binary())) for i, c in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, most - n)
                at, n = at + part.num_rows, n + part.num_rows
                waiting.append(part)
                if n == most:
                    yield made(waiting)
                    waiting, n = [], 0
        if n:
            yield made(waiting)

    return rows.select("carried", "v").mapInArrow(run, fields)


def trees_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[Tree]]]:
    columns = [batch.column(c) for c in ("points", "place", "low", "high", "total", "span")]
    for i in range(batch.num_rows):
        yield i, [Tree.unpacked([c[i][p].as_py() for c in columns], width // PARTS) for p in range(PARTS)]


def improved(blocks: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The codebooks after one round: each entry the floor of its parts' mean; unused ones stay."""
    size = width // PARTS
    sent = blocks.sparkSession.sparkContext.broadcast(books)  # PARTS * ENTRIES entries at most
    names = [f"s{j}" for j in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books_shape, np.int64), np.zeros(books_shape[:2], np.int64)
        for batch in batches:
            for _, trees in trees_of(batch, width):
                for p, tree in enumerate(trees):
                    tree.add_to(sent.value[p], total[p], count[p])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"part": part, "entry": entry, "n": count[part, entry]} | {c: total[part, entry, j] for j, c in enumerate(names)})

    books_shape = books.shape
    sums = blocks.select("points", "place", "low", "high", "total", "span").mapInArrow(run, ", ".join(f"{c} long" for c in ("part", "entry", "n", *names)))
    found = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).toArrow()
    sent.unpersist()
    out = books.copy()
    part, entry, n = (found.column(c).to_numpy() for c in ("part", "entry", "n"))
    for j, c in enumerate(names):
        out[part, entry, j] = found.column(c).to_numpy() // n
    return out


@owned
def compressed(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """`rows` without embedding and with code (two hex digits for each part's entry) and error (squared distances, summed); the codebooks.

    rows: vec_id, embedding and any other columns; those of the names made are replaced. Rows whose vector is null, or has
    null or non-finite components, are left out. Codebooks, whole numbers of the shape (PARTS, entries, width / PARTS), start
    from the `entries` smallest ids, a null id last, of one id the smaller vectors first; with fewer rows they have as many
    entries as rows. Rows that repeat each count. Shorter vectors, and all of a length that PARTS does not divide, end with
    zeros. Components beyond bound(width) count as that. Ties go to the lower entry. An empty table stays empty.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part, so a codebook has 256 entries at most")
    found = whole_numbers(rows, scale)
    width = -(-max(found.agg(F.max(F.size("v"))).first()[0] or 0, 0) // PARTS) * PARTS
    first = found.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    books = np.clip(matrix(first.column("v").combine_chunks(), width), -bound(width), bound(width))
    books = np.ascontiguousarray(books.reshape(len(books), PARTS, width // PARTS).swapaxes(0, 1))
    found, rest = apart(found, "vec_id", "v")
    found = found.select(F.struct("vec_id", "carried").alias("carried"), "v")
    blocks = written(in_blocks(found, width, block), kept=True)
    for _ in range(rounds):
        books = improved(blocks, books, width)
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("held")
            for i, trees in trees_of(batch, width):
                pairs = [tree.assigned(sent.value[p]) for p, tree in enumerate(trees)]
                digits = np.column_stack([entry for entry, _ in pairs]).astype(np.uint8).tobytes().hex()
                code = pa.array([digits[at : at + 2 * PARTS] for at in range(0, len(digits), 2 * PARTS)], pa.string())
                yield pa.RecordBatch.from_pydict({"carried": held[i].values, "code": code, "error": sum(error for _, error in pairs)})

    one = blocks.select(F.explode("held").alias("carried"))
    made = blocks.mapInArrow(run, with_fields(one, ["carried"], "code string, error long"))
    made = made.select(F.col("carried.vec_id").alias("vec_id"), F.col("carried.carried").alias("carried"), "code", "error")
    return together(made, rest, "vec_id", "code", "error"), books


def rebuilt(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """`codes` with `approximation`, the vector that each code stands for, in place of any column of that name; a null code gives a null."""
    sent = codes.sparkSession.sparkContext.broadcast(books / scale)
    codes = codes.drop("approximation")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if c is None else np.concatenate([b[e] for b, e in zip(sent.value, bytes.fromhex(c), strict=True)]) for c in batch.column("code").to_pylist()]
            yield batch.append_column("approximation", pa.array(made, pa.list_(pa.float64())))

    return codes.mapInArrow(run, with_fields(codes, codes.columns, "approximation array<double>"))


def with_sum(rows: DataFrame, by: str, of: str, name: str, most_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """`rows` with the sum of `of` over the rows of equal `by`, nulls together. rows: a written table.

    Few sums are broadcast; more than `most_broadcast` meet their rows in a join whose keys are salted, as one key may hold many rows.
    """
    sums = written(rows.groupBy(F.col(by).alias("_by")).agg(F.sum(of).alias(name)), kept=True)
    if sums.count() <= most_broadcast:
        return rows.join(F.broadcast(sums), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    sums = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_of", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return salted.join(sums.hint("merge"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_of") == F.col("_salt")), "left").drop("_by", "_salt", "_of")


def digest(books: np.ndarray) -> str:
    """The SHA-256 of all components in decimal, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


@owned
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 11."""
    books = []

    def codes() -> DataFrame:
        found, made = compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
        books.append(made)
        return found

    found = with_sum(settled(spark, codes, kept=True), "label", "error", "label_error")
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(*books)).alias("codebooks_sha256"))


def _sql() -> str:
    nearest = """
    a{r} AS MATERIALIZED (
        SELECT vec_id, p, o.e AS e, o.d AS d FROM (
            SELECT x.vec_id, x.p, min({{'d': list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, z.v) + list_inner_product(z.v, z.v), 'e': z.e}}) AS o
            FROM parts x JOIN b{r} z ON x.p = z.p GROUP BY x.vec_id, x.p))"""
    better = """
    m{r} AS (
        SELECT p, e, i, floor(sum(x) / count(*)) AS x
        FROM (SELECT p, e, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM parts JOIN a{r} USING (vec_id, p)) GROUP BY p, e, i),
    b{n} AS MATERIALIZED (
        SELECT p, e, coalesce(n.v, b{r}.v) AS v
        FROM b{r} LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS v FROM m{r} GROUP BY p, e) n USING (p, e))"""
    rounds = ",".join(nearest.format(r=r) + "," + better.format(r=r, n=r + 1) for r in range(ROUNDS))
    return f"""
    WITH kept AS (
        SELECT vec_id, label, [floor({SCALE} * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    parts AS MATERIALIZED (
        SELECT vec_id, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS v FROM kept, range({PARTS}) t(p)),
    firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
    b0 AS MATERIALIZED (SELECT p, e, v FROM parts JOIN firsts USING (vec_id)),{rounds},{nearest.format(r=ROUNDS)},
    codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
    digest AS (SELECT sha256(string_agg(array_to_string([CAST(x AS BIGINT) for x in v], ','), ',' ORDER BY p, e)) AS s FROM b{ROUNDS})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
    FROM codes JOIN kept USING (vec_id), digest"""


ORACLE_SQL = _sql()
