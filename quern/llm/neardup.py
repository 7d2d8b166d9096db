"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds the hashes of its distinct five-word shingles. Two small collections U and V of M keys each, a key
made of K minhashes, stand for M * M tables: the table (i, j) has the key (U_i, V_j). So M * M tables of 2 * K minhashes
need 2 * M * K minhashes instead of M * M * 2 * K. Two documents are candidates if some U_i and some V_j agree:
with K = 5 and M = 36 a pair of similarity 0.75 is missed with a chance of 1.2e-4, one of 0.8 with less than 2e-6.

A pair is in one of the M * M tables if and only if it shares a key of U and a key of V, so tables are not written out:
candidates come from buckets of U and must share a key of V. No bucket is expanded into all of its pairs. Equal sets are
one node from the start. In a bucket of U, members are first compared with the smallest one only; a bucket whose members
these links join into one class needs nothing more. In the others, members outside the largest class are paired with those
of other classes, if their sizes and a bound from the parities of their shingles' hashes allow a link. Where that would be
too many tests, the bucket's members are dealt out anew by their rarest shingles, of which linked sets share one. Every
candidate is confirmed on full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bytesweep import NOT_SPACE, Sweep, chunks, mix, runs
from quern.llm.shared import over_texts, owned, removed, written
from quern.sources.tables import table

SHINGLE = 5
#: A link needs PERCENT * |union| <= 100 * |intersection|.
PERCENT = 75
K, M = 5, 36
#: Cells of the parity bound, a multiple of 64.
PARITIES = 1024
#: Tests of pairs that a bucket may need; beyond, its members are dealt out anew. Cells that shingles are counted in then.
SPLIT, CELLS = 1 << 22, 1 << 20

_rng = np.random.default_rng(20)
FACTOR = (_rng.integers(0, 1 << 32, 2 * K * M, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
TERM = _rng.integers(0, 1 << 32, 2 * K * M, dtype=np.uint64).astype(np.uint32)
TABLE = np.arange(2 * M, dtype=np.uint64)


def shingle_sets(texts: list, k: int = SHINGLE) -> list[np.ndarray]:
    """Of each whole text the sorted hashes of its distinct shingles; a shorter text is one shingle, an empty one has none."""
    sweep = Sweep(texts, NOT_SPACE)
    words = sweep.hashes()
    every = runs(words, k)
    out = []
    for lo, hi in zip(sweep.first[:-1], sweep.first[1:], strict=True):
        n = hi - lo
        out.append(np.unique(every[lo : hi - k + 1]) if n >= k else runs(words[lo:hi], n) if n else every[:0])
    return out


def minhashes(found: np.ndarray) -> np.ndarray:
    """2 * K * M minhashes of a set that is not empty."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = None
    for at in range(0, len(x), 1024):
        block = x[at : at + 1024, None] * FACTOR
        block += TERM
        low = block.min(axis=0)
        least = low if least is None else np.minimum(least, low)
    return least


def sketch(texts: list) -> dict:
    """n_shingles, a digest of the set, and its keys of U and V."""
    size, digest, u, v = [], [], [], []
    for found in shingle_sets(texts):
        size.append(len(found))
        if not len(found):
            digest.append(None)
            u.append(None)
            v.append(None)
            continue
        digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
        least = minhashes(found).astype(np.uint64).reshape(2 * M, K)
        key = TABLE.copy()
        for j in range(K):
            key = mix(key ^ least[:, j]) + np.uint64(j)
        key = key.astype(np.int64)
        u.append(key[:M])
        v.append(key[M:])
    longs = pa.list_(pa.int64())
    return {"n_shingles": pa.array(size, pa.int64()), "digest": pa.array(digest, pa.binary()), "u": pa.array(u, longs), "v": pa.array(v, longs)}


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. sets: id, found."""
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("found").alias("found_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("found").alias("found_b")), "b")

    def similar(x: pa.Scalar, y: pa.Scalar) -> bool:
        x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))  # views of the batch
        at = np.minimum(np.searchsorted(x, y), len(x) - 1)
        both = int((x[at] == y).sum())
        return 100 * both >= PERCENT * (len(x) + len(y) - both)

    def run(batches):
        for batch in batches:
            kept = pa.array([similar(x, y) for x, y in zip(batch.column("found_a"), batch.column("found_b"), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(kept), "b": batch.column("b").filter(kept)})

    return joined.select("a", "b", "found_a", "found_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, kept: bool = False) -> DataFrame:
    """(id, component) of every node but the smallest of each class, by alternating large and small stars."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), kept)
    before = None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == before or not seen.n:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = seen
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.a", "e.b")
        old, edges = edges, written(small.where("a != b").distinct(), kept)
        removed(old)


def shared_keys(keys: DataFrame, by: list[str], of: str = "id") -> DataFrame:
    """The rows of `keys` whose values of `by` occur with more than one value of `of`; `least` is the smallest of these."""
    groups = keys.groupBy(*by).agg(F.min(of).alias("least"), F.max(of).alias("most")).where("least < most").drop("most")
    return keys.join(groups, by)


def full_set(texts: list) -> dict:
    """The set of each text as bytes, its size, and the parities of its hashes over PARITIES cells, as longs p0, p1 and so on."""
    sets = shingle_sets(texts)
    odd = np.array([np.packbits(np.bincount((s % PARITIES).astype(np.int64), minlength=PARITIES) & 1) for s in sets]).reshape(len(sets), -1)
    longs = odd.view(np.int64)
    made = {"found": pa.array([s.tobytes() for s in sets], pa.binary()), "size": pa.array(map(len, sets), pa.int64())}
    return made | {f"p{i}": pa.array(longs[:, i]) for i in range(PARITIES // 64)}


def open_buckets(members: DataFrame) -> DataFrame:
    """The rows (id, class, u) of buckets that hold several classes, with `main`, the class with the most members there."""
    by_class = members.groupBy("u", "class").agg(F.count("*").alias("n"))
    main = by_class.groupBy("u").agg(F.max(F.struct("n", "class"))["class"].alias("main"), F.count("*").alias("classes")).where("classes > 1")
    return members.join(main.drop("classes"), "u")


def open_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of different classes that share a bucket of U and are not excluded by their sizes and parities.

    Sets that differ in d parities differ in d shingles or more, so |union| - |intersection| >= d. The join makes no row
    for a pair whose similarity this bound puts below the threshold. A pair of two classes has a member outside the
    bucket's main class, so only these are tested against all members. members: id, class, u, main.
    """
    rows = members.join(sets.drop("found"), "id")
    other = rows.drop("main").select("u", *[F.col(c).alias(f"{c}_b") for c in rows.columns if c not in ("u", "main")])
    apart = sum(F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(PARITIES // 64))
    # |union| = (|a| + |b| + apart) / 2 and |intersection| = (|a| + |b| - apart) / 2 at best
    both = F.col("size") + F.col("size_b")
    fits = 100 * (both - apart) >= PERCENT * (both + apart)
    once = (F.col("class_b") == F.col("main")) | (F.col("id") < F.col("id_b"))
    pairs = rows.where("class != main").join(other, "u").where((F.col("class") != F.col("class_b")) & once & fits)
    return pairs.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"))


def rarest(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, class, u): of each member so many of its rarest shingles, as u, that any two sets that may be linked share one.

    Of two linked sets each has PERCENT of its shingles in the other. So if all shingles are put into one order, and the
    last ones of a set, PERCENT of them less one, are left out, the two share one of those that are left. The order is by
    how often a shingle's cell occurs among the members, so that what only few of them have comes first. members: id, class.
    """
    mine = members.join(sets.select("id", "found"), "id")

    def counted(batches):
        count = np.zeros(CELLS, np.int64)
        for batch in batches:
            sets = batch.column("found")
            for lo, hi in chunks(pc.binary_length(sets).to_pylist(), 1 << 24):
                shingles = np.concatenate([np.frombuffer(found.as_buffer(), np.uint64) for found in sets.slice(lo, hi - lo)])
                count += np.bincount((shingles % CELLS).astype(np.int64), minlength=CELLS)
        cell = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cell": cell, "n": count[cell]})

    seen = mine.select("found").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    often = np.zeros(CELLS, np.int64)
    often[seen.column("cell").to_numpy()] = seen.column("n").to_numpy()
    sent = members.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        for batch in batches:
            for i, found in enumerate(batch.column("found")):
                shingles = np.frombuffer(found.as_buffer(), np.uint64)
                n = sent.value[(shingles % CELLS).astype(np.int64)]
                first = np.lexsort((shingles, n))[: len(shingles) - -(-PERCENT * len(shingles) // 100) + 1]
                u = shingles[first[n[first] > 1]].astype(np.int64)  # a cell that occurs once is shared with nobody
                yield pa.RecordBatch.from_pydict({"id": pa.array(np.full(len(u), batch.column("id")[i].as_py())), "class": pa.array(np.full(len(u), batch.column("class")[i].as_py())), "u": u})

    return mine.select("id", "class", "found").mapInArrow(run, "id long, class long, u long")


def pairs_of_open(open_u: DataFrame, sets: DataFrame, split: int) -> DataFrame:
    """The pairs (a, b) of open_pairs(); buckets that would need more than `split` tests go by their members' rarest shingles."""
    n_other = F.sum((F.col("class") != F.col("main")).cast("long"))
    large = written(open_u.groupBy("u").agg((F.count("*") * n_other).alias("tests")).where(F.col("tests") > split).select("u"))
    if large.isEmpty():
        return open_pairs(open_u, sets)
    direct = open_pairs(open_u.join(large.hint("merge"), "u", "left_anti"), sets)
    members = written(open_u.join(large.hint("merge"), "u", "left_semi").select("id", "class").distinct())
    return direct.union(open_pairs(open_buckets(written(rarest(members, sets))), sets))


def classed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """`rows` with the class of each id, itself where it has no link yet."""
    return rows.join(classes, "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component")


def meeting(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) that meet in a table (U_i, V_j), so share a key of U and one of V, and whose sizes allow a link."""
    left, right = (keys.select(F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col("u").alias(f"u_{x}"), F.col("v").alias(f"v_{x}")) for x in "ab")
    sizes_fit = f"100 * least(size_a, size_b) >= {PERCENT} * greatest(size_a, size_b)"
    both = pairs.distinct().join(left, "a").join(right, "b").where(sizes_fit)
    return both.where(F.arrays_overlap("u_a", "u_b") & F.arrays_overlap("v_a", "v_b")).select("a", "b").distinct()


@owned
def near_duplicates(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs`, which has doc_id and text.

    A document without words, or with a null text, is linked with nothing. A row with a null id takes no part: its
    component is null and it is kept. Rows that repeat, or share an id, are one document, linked with whatever any of its
    texts is linked with, and are returned as often as they occur. Texts are taken whole, however long; of equal documents
    the smallest id stands for all. Other columns are not carried. An empty table stays empty.
    """
    texts = docs.select("doc_id", "text")
    sketches = written(over_texts(texts, "text", sketch, "n_shingles long, digest binary, u array<long>, v array<long>"), kept=True)
    same = written(sketches.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), kept=True)
    nodes = sketches.join(same.select("digest", F.col("id").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    nodes = nodes.dropDuplicates(["digest"]).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "u", "v")

    in_u = written(shared_keys(nodes.select("id", F.explode("u").alias("u")), ["u"]))
    ids = in_u.select("id").distinct()
    colliding = written(nodes.join(ids, "id", "left_semi").select("id", "size", "u", "v"))
    # these ids grow with the documents, so they are not broadcast, however few they are
    wanted = texts.join(ids.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left_semi")
    parities = ", ".join(f"p{i} long" for i in range(PARITIES // 64))
    sets = over_texts(wanted.withColumnRenamed("doc_id", "id"), "text", full_set, f"found binary, size long, {parities}")
    sets = written(sets.where("size > 0").dropDuplicates(["id", "found"]))

    # an id with several texts links the nodes of all of them
    several = sketches.where("digest is not null and doc_id is not null").select("doc_id", F.xxhash64("digest").alias("h"))
    several = several.groupBy("doc_id").agg(F.min("h").alias("one"), F.max("h").alias("other")).where("one != other")
    own = sketches.join(several.select("doc_id"), "doc_id", "left_semi").join(same, "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))

    stars = in_u.where("id != least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    links = written(confirmed(meeting(stars, colliding), sets).union(own))
    classes = components(links)
    open_u = written(open_buckets(classed(in_u.select("id", "u"), classes)))
    rest = confirmed(meeting(pairs_of_open(open_u, sets, split), colliding), sets)
    # classes are links already, of each member with its smallest
    classes = components(classes.select(F.col("id").alias("a"), F.col("component").alias("b")).union(rest), kept=True)
    removed(in_u, colliding, sets, links, open_u)
    of_set = same.join(classes, "id", "left").where("n > 1 or component is not null").select("digest", F.coalesce("component", "id").alias("component_id"))
    found = sketches.select("doc_id", "n_shingles", "digest").join(of_set, "digest", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 9."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s
        FROM words),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
        GROUP BY 1, 2),
    links AS (
        SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
        WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)),
    reach AS (
        SELECT doc_id AS a, doc_id AS b FROM documents
        UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
    FROM documents d LEFT JOIN sizes s USING (doc_id)
    JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""
