import random
import re
import struct

import pytest
import xxhash
from llm import cases
from pyspark.sql import functions as F

from quern.llm import mixing
from quern.sources.tables import table


def level(sizes, weights, most):
    """Targets by the contract's own words: cut what is above its bound, share the excess by weight, again and again."""
    total = sum(sizes)
    target = [0.0] * len(sizes)
    fixed = set()
    while True:
        left = total - sum(most * sizes[i] for i in fixed)
        weight = sum(w for i, w in enumerate(weights) if i not in fixed)
        for i, w in enumerate(weights):
            target[i] = most * sizes[i] if i in fixed else left * w / weight
        over = {i for i, t in enumerate(target) if t > most * sizes[i] + 1e-9} - fixed
        if not over:
            return target
        fixed |= over


@pytest.mark.parametrize("sizes", [[100, 100, 100, 100], [1, 1000, 5, 7, 0], [10, 1, 1, 1000], [3]])
def test_targets(spark, sizes):
    rows = [(f"s{i}", s) for i, s in enumerate(sizes)]
    rows[-1] = (None, sizes[-1])
    frame = spark.createDataFrame(rows, "source string, size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    want = level(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3)
    assert [got[s] for s, _ in rows] == pytest.approx(want, abs=1e-6)


def test_every_source_meets_its_target(spark):
    sf = "/root/testdata/sf0.01"
    found = mixing.op6_mix(spark, sf)
    rows = found.collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in table(spark, sf, "documents").collect()}
    assert len(rows) == len(size) and all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"] for r in rows)
    sources = sorted({r.source for r in rows})
    of = {s: [r for r in rows if r.source == s] for s in sources}
    want = level([sum(r["size"] for r in of[s]) for s in sources], [(5, 2, 1)[i % 3] for i in range(len(sources))], 3)
    for s, t in zip(sources, want, strict=True):
        assert of[s][0].target == pytest.approx(t) and of[s][0].source_size == sum(r["size"] for r in of[s])
        assert abs(sum(r.taken for r in of[s]) - t) <= 0.02 * t
    assert cases.sorted_rows(mixing.op6_mix(spark, sf)) == cases.sorted_rows(found)


def plain_fold(items):
    """The open item and the decisions of a group, from the method's own words. items: (id, size, p), in order."""

    def draw(*ids):
        h = xxhash.xxh64_intdigest(struct.pack("<i", mixing.SEED), 42)
        for i in ids:
            h = xxhash.xxh64_intdigest(i.encode(), h)
        return h % (1 << 52) / (1 << 52)

    open_, done = None, []
    for b in items:
        now = [b] if open_ is None else [open_, b]
        if open_ is not None:
            (a, size_a, p_a), (b, size_b, p_b) = now
            to_a, to_b = min((1 - p_a) * size_a, p_b * size_b), min(p_a * size_a, (1 - p_b) * size_b)
            moved = to_a if draw(a, b) * (to_a + to_b) < to_b else -to_b
            now, open_ = [(a, size_a, p_a + moved / size_a), (b, size_b, p_b - moved / size_b)], None
        for i, size, p in now:
            if open_ is not None or p < 1e-9 or p > 1 - 1e-9:
                done.append((i, p > 0.5))
            else:
                open_ = (i, size, p)
    return open_, done


def test_fold_against_a_plain_one(spark):
    rnd = random.Random(11)
    groups = {g: sorted((f"{g}:{i}", float(rnd.randrange(1, 60)), rnd.choice([0.25, 0.5, 0.75, rnd.random() * 0.98 + 0.01])) for i in range(rnd.randrange(1, 40))) for g in range(40)}
    frame = spark.createDataFrame([(g, items) for g, items in groups.items()], "g int, items array<struct<id:string,size:double,p:double>>")
    for r in frame.select("g", mixing.folded(F.col("items")).alias("s")).collect():
        open_, done = plain_fold(groups[r.g])
        assert [tuple(d) for d in r.s.done] == done
        assert (r.s.open is None) == (open_ is None) and (open_ is None or (r.s.open.id == open_[0] and r.s.open.p == pytest.approx(open_[2])))


def test_rounding_keeps_expectation_and_words(spark):
    """Over many groups of their own, the share of documents taken is near p, and each group's words near their sum."""
    rows = [(f"s{s}", f"{s}:{i}", float(1 + (i * 7) % 13), 0.3) for s in range(300) for i in range(25)]
    items = spark.createDataFrame(rows, "source string, key string, size double, p double")
    done = items.join(mixing.rounded(items, group=8), "key")
    assert done.count() == len(rows)
    by = done.groupBy("source").agg(F.sum(F.when(F.col("take"), F.col("size")).otherwise(0)).alias("have"), F.sum(F.col("size") * F.col("p")).alias("want"), F.max("size").alias("most"))
    assert by.where("abs(have - want) > most").count() == 0
    share = done.groupBy("size").agg(F.avg(F.col("take").cast("int")).alias("s"), F.count("*").alias("n")).collect()
    assert all(abs(r.s - 0.3) < 5 * (0.21 / r.n) ** 0.5 for r in share)


def test_odd_rows(spark):
    docs = cases.odd_docs(spark).withColumn("size", F.lit("x")).withColumn("target", F.lit("y")).withColumn("copies", F.lit(0))
    found = mixing.mixed(docs)
    assert found.count() == docs.count() and found.where("size = 0 and size * copies > 0").count() == 0
    assert mixing.mixed(cases.docs(spark, [])).count() == 0
    assert mixing.mixed(cases.docs(spark, [(1, None), (2, "")])).where("target != 0").count() == 0


def test_rows_that_repeat(spark, monkeypatch):
    """A third of the rows are one row, a third share an id: all are documents of their own, and sources meet their targets."""
    monkeypatch.setattr(mixing, "AT_ONCE", 64)
    rows = [(1, "one row again and again", "a")] * 500 + [(2, f"word{i} " * (1 + i % 9), "b") for i in range(500)] + [(3 + i, "x y z " * (i % 7), "c") for i in range(500)]
    docs = cases.docs(spark, rows + [(None, None, "c")] * 200)
    found = mixing.mixed(docs).collect()
    assert len(found) == 1700 and len({(r.variant, r.copy) for r in found}) == 1700
    assert sum(r.doc_id == 1 for r in found) == sum(r.doc_id == 2 for r in found) == 500 and sum(r.doc_id is None for r in found) == 200
    for s in "abc":
        of = [r for r in found if r.source == s]
        assert sum(r["size"] for r in of) == of[0].source_size
        assert abs(sum(r["size"] * r.copies for r in of) - of[0].target) <= 0.02 * of[0].target


def test_repeated(spark, monkeypatch):
    monkeypatch.setattr(mixing, "AT_ONCE", 64)
    rows = spark.createDataFrame([("a", 1), ("b", 64), ("c", 65), ("d", 1000)], "variant string, n long")
    for largest in (1000, 10):  # dealt out or not
        got = mixing.repeated(rows, "n", largest).collect()
        assert sorted((r.variant, r.copy) for r in got) == [(v, i) for v, n in (("a", 1), ("b", 64), ("c", 65), ("d", 1000)) for i in range(n)]
