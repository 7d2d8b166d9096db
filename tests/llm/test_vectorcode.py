import hashlib

import numpy as np
import pytest
from llm import cases

from quern.llm import vectorcode


def brute(v, entries, rounds):
    """(code, error) of each row and the codebooks, with every distance written out. v: whole numbers, in order of their ids."""
    parts = np.split(v, vectorcode.PARTS, axis=1)
    codes, errors, books = [], 0, []
    for part in parts:
        book = part[:entries].copy()
        for step in range(rounds + 1):
            distance = ((part[:, None, :] - book[None]) ** 2).sum(axis=2)
            nearest = distance.argmin(axis=1)  # the first of equals
            if step < rounds:
                for e in np.unique(nearest):
                    book[e] = part[nearest == e].sum(axis=0) // (nearest == e).sum()
        codes.append(nearest)
        errors = errors + distance.min(axis=1)
        books.append(book)
    return ["".join(f"{e:02x}" for e in row) for row in zip(*codes, strict=True)], errors.tolist(), np.array(books)


def vectors(kind, n, width, rng):
    if kind == "ties":
        return rng.integers(-2, 3, (n, width)) / 1024
    if kind == "clusters":
        return (rng.normal(size=(20, width))[rng.integers(0, 20, n)] + rng.normal(size=(n, width)) * 0.02).round(4)
    if kind == "large":
        return rng.integers(-40_000, 40_000, (n, width)).astype(float)
    return rng.normal(size=(n, width)).round(4)


@pytest.mark.parametrize("kind", ["ties", "clusters", "large", "spread"])
@pytest.mark.parametrize("entries,block", [(5, 1 << 19), (64, 2000)])
def test_against_brute_force(spark, kind, entries, block):
    rng = np.random.default_rng(entries)
    v = vectors(kind, 700, 8, rng)
    v[300:400] = v[7]
    order = rng.permutation(700)
    frame = spark.createDataFrame([(int(i), v[i].tolist(), int(i) % 3) for i in order], "vec_id long, embedding array<double>, error long").repartition(3)
    codes, books = vectorcode.compressed(frame, entries, 3, block=block)
    want = brute(np.floor(v * 1024).astype(np.int64), entries, 3)
    got = sorted((r.vec_id, r.code, r.error) for r in codes.collect())
    assert [g[1] for g in got] == want[0]
    assert [g[2] for g in got] == want[1]
    assert (books == want[2]).all()
    assert vectorcode.digest(books) == hashlib.sha256(",".join(str(x) for b in want[2] for e in b for x in e).encode()).hexdigest()


def test_subtrees_are_assigned_at_once():
    """On clustered parts most points are never looked at, and most entries are eliminated for the rest."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-100_000, 100_000, (64, 4))
    points = (centres[rng.integers(0, 64, 20_000)] + rng.integers(-50, 50, (20_000, 4))).astype(np.int64)
    tree = vectorcode.Tree.of(points)
    looked_at = sum(hi - lo for lo, hi, node, _ in tree.filtered(centres) if node < 0)
    assert looked_at < 0.2 * len(points)
    entry, error = tree.assigned(centres)
    distance = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (entry == distance.argmin(axis=1)).all() and (error == distance.min(axis=1)).all()
    again = vectorcode.Tree.unpacked(tree.packed(), 4)
    assert (again.assigned(centres)[0] == entry).all()


def test_odd_rows(spark):
    rows = [(0, [0.5, -0.5], "a"), (1, None, "a"), (2, [float("nan"), 1.0], "a"), (3, [float("inf"), 1.0], "a"), (4, [None, 1.0], "a"), (5, [1.0, 2.0, 3.0, 4.0, 5.0], None), (None, [1.0], None), (5, [1.0, 2.0, 3.0, 4.0, 5.0], None), (6, [], "b"), (7, [1e300, -1e300], "b")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string")
    codes, books = vectorcode.compressed(frame)
    assert books.shape == (4, 6, 2)
    got = cases.sorted_rows(codes.select("vec_id", "code", "error"))
    # each row is its own entry, ties to the lower one; null ids come last
    assert [r[0] for r in got] == [None, 0, 5, 5, 6, 7] and all(r[2] == 0 for r in got)
    again = vectorcode.rebuilt(codes, books).where("vec_id = 5").first()
    assert again.approximation == [1.0, 2.0, 3.0, 4.0, 5.0, 0.0, 0.0, 0.0]
    empty, none = vectorcode.compressed(frame.limit(0))
    assert empty.count() == 0 and none.shape == (4, 0, 0)
    alike, _ = vectorcode.compressed(spark.createDataFrame([(i, []) for i in range(3)], "vec_id long, embedding array<float>"))
    assert {(r.code, r.error) for r in alike.collect()} == {("00000000", 0)}


@pytest.mark.parametrize("most", [0, 100])
def test_sums(spark, most):
    """Broadcast or joined with salted keys, the sums are the same; nulls are together."""
    frame = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3, i) for i in range(60)], "vec_id long, label int, error long")
    found = vectorcode.with_sum(vectorcode.written(frame), "label", "error", "s", most)
    want = {}
    for r in frame.collect():
        want[r.label] = want.get(r.label, 0) + r.error
    assert [(r.vec_id, r.s) for r in found.orderBy("vec_id").collect()] == [(i, want[None if i % 5 == 0 else i % 3]) for i in range(60)]


def test_against_sql(spark):
    cases.against_sql(spark, vectorcode.op11_vector_codes, vectorcode.ORACLE_SQL)
    cases.against_sql(spark, vectorcode.op11_vector_codes, vectorcode.ORACLE_SQL, "/root/testdata/sf0.01")
