"""Held-out accuracy of the two learned scores, and their odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from llm import cases
from pyspark.sql import functions as F

from quern.llm import quality, toxicity
from quern.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query,label,recall,precision", [(quality.op8_quality, "quality", 0.95, 0.9), (toxicity.op3_toxicity, "toxic", 0.6, 0.7)])
def test_held_out(spark, query, label, recall, precision):
    found = query(spark, SF)
    assert found.count() == table(spark, SF, "documents").count()
    assert found.where("score is null or score < 0 or score > 1").count() == 0
    rows = found.join(table(spark, SF, "labels"), "doc_id").where("held_out").select(label, "predicted").collect()
    good = sum(a == b == 1 for a, b in rows)
    assert good >= recall * sum(a for a, _ in rows) and good >= precision * sum(b for _, b in rows)


def test_odd_rows(spark):
    labels = table(spark, cases.SF, "labels")
    docs = cases.odd_docs(spark)
    train = table(spark, cases.SF, "documents").unionByName(docs)
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        found = scores(train.withColumnRenamed("lang", "score").withColumn("x0", F.lit("x")), labels)
        assert found.where("score is null").count() == 0 and found.count() == train.count()
        assert scores(docs, labels.limit(0)).where("score is null").count() == 0
        assert scores(docs.limit(0), labels).count() == 0
        assert scores(docs, labels.withColumn("quality", F.lit(None).cast("int")).withColumn("toxic", F.lit(None).cast("int"))).count() == docs.count()


def test_fold_zero_teaches_nothing(spark):
    """Labels of held-out rows may say anything: scores stay."""
    docs, labels = (table(spark, cases.SF, t) for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        assert cases.sorted_rows(scores(docs, labels).select("doc_id", F.round("score", 4))) == cases.sorted_rows(scores(docs, other).select("doc_id", F.round("score", 4)))


def test_risk_and_its_gradient():
    """The risk against its formula, the gradients against finite differences, on a few rows."""
    rng = np.random.default_rng(3)
    p, u, w = rng.normal(size=(7, 4)), rng.normal(size=(11, 4)), rng.normal(size=5)
    loss = lambda z: np.log(1 + np.exp(-z))

    def parts(w):
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        return 0.3 * loss(zp).mean(), loss(-zu).mean() - 0.3 * loss(-zp).mean()

    good, bad, of_good, of_bad = quality.risk(p, u, 0.3, w)
    assert (good, bad) == pytest.approx(parts(w))
    for k in range(5):
        step = np.eye(5)[k] * 1e-5
        change = (np.array(parts(w + step)) - np.array(parts(w - step))) / 2e-5
        assert (of_good[k], of_bad[k]) == pytest.approx(tuple(change), abs=1e-5)


def test_risk_falls_and_stays_above_zero():
    rng = np.random.default_rng(4)
    good, bad = rng.normal(1, 1, (400, 3)).astype(np.float32), rng.normal(-1, 1, (600, 3)).astype(np.float32)
    w = quality.minimise(good[:200], np.vstack([good[200:], bad]), 0.25)
    z = np.vstack([good, bad]) @ w[:-1] + w[-1]
    assert (z[:400] > 0).mean() > 0.9 and (z[400:] < 0).mean() > 0.9
    a, b, _, _ = quality.risk(good[:200], np.vstack([good[200:], bad]), 0.25, w)
    assert a + max(b, 0) < 0.25 * np.log(2) + 0.75 * np.log(2) and b > -0.05


def test_every_row_is_in_a_block(spark):
    """Blocks of 100 rows fit much the same model as one block of all, and none of the rows is left out."""
    docs, labels = (table(spark, SF, t) for t in ("documents", "labels"))
    one, many = quality.fit(docs, labels), quality.fit(docs, labels, block=100)
    texts = [r.text for r in docs.collect()]
    assert np.mean((one.score(texts) >= 0.3) == (many.score(texts) >= 0.3)) > 0.97
    assert quality.packed(docs).count() == len(texts)


def test_order_of_rows_changes_no_score(spark):
    """Several blocks, rows in another order and other partitions, some of them repeated: equal scores."""
    docs, labels = (table(spark, cases.SF, t) for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").union(docs.select("doc_id", "text").where("doc_id % 7 = 0")).union(docs.select("doc_id", "text").where("doc_id = 3"))
    other = docs.repartition(7).orderBy(F.xxhash64("text", F.lit(5)))
    one, two = (cases.sorted_rows(quality.quality_scores(d, labels, block=40)) for d in (docs, other))
    assert one == two and len({r[1] for r in one}) > 50


def test_blocks_are_even(spark):
    """Every row is in a block; a row that repeats is spread over all of them."""
    rows = spark.createDataFrame([(i, b"x") for i in range(500)] + [(-1, b"y")] * 700, "h long, x binary")
    found = quality.dealt(rows, 10).groupBy("block").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("h") == -1, F.col("n"))).alias("same"))
    found = found.collect()
    assert len(found) == 10 and sum(r.n for r in found) == 1200 and {r.same for r in found} == {70}
    assert all(80 < r.n < 170 for r in found)


def test_elkan_noto_when_no_negative_is_labelled(spark):
    docs, labels = (table(spark, SF, t) for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("quality = 1"))
    assert 0.05 <= model.prior <= 0.95


def test_grams_stay_within_words():
    gram, owner = toxicity.grams(["ab c", "", None, "É"])
    decode = [bytes(int(g).to_bytes(5, "big")) for g in gram]
    assert decode[:3] == [b"\0\0\0\0a", b"\0\0\0ab", b"\0\0ab\0"] and owner.tolist()[:3] == [0, 0, 0]
    assert decode[3:5] == [b"\0\0\0\0c", b"\0\0\0c\0"]
    assert set(owner.tolist()) == {0, 3}


def plain_kneser_ney(texts, labels):
    """The two models as their formulas read, over tuples of bytes: llr(context and symbol)."""
    order, d = toxicity.ORDER, toxicity.DISCOUNT
    count = [Counter(), Counter()]
    for text, label in zip(texts, labels, strict=True):
        for word in words(text):
            count[label].update(word)
    seen = {order: Counter(set(count[0]) | set(count[1]))}
    for k in range(order - 1, 0, -1):
        seen[k] = Counter(g[1:] for g in seen[k + 1])

    def shared(g):
        k = len(g)
        if not k:
            return 1 / 256
        same = [n for h, n in seen[k].items() if h[:-1] == g[:-1]]
        return (max(seen[k][g] - d, 0) + d * len(same) * shared(g[1:])) / sum(same) if same else shared(g[1:])

    def chance(g, c):
        same = [n for h, n in c.items() if h[:-1] == g[:-1]]
        return (max(c[g] - d, 0) + d * len(same) * shared(g[1:])) / sum(same) if same else shared(g[1:])

    return lambda g: math.log(chance(g, count[1]) / chance(g, count[0]))


def words(text):
    """Of each word the n-grams of its bytes and its end."""
    order = toxicity.ORDER
    for word in re.findall(rb"[a-z\x80-\xff]+", text.lower().encode()):
        whole = (0,) * order + tuple(word) + (0,)
        yield [whole[i + 1 - order : i + 1] for i in range(order, len(whole))]


def test_against_plain_kneser_ney(spark):
    """Counts, shared backoff, class-conditional likelihoods and the three figures of a text, on a few texts."""
    texts = ["you are a damned fool and a fool", "what a fine day it is today", "damn the foolish day", "It is Fine, é and ß too", "", "fool fool fool"]
    labels = [1, 0, 1, 0, 0, 1]
    frame = spark.createDataFrame(list(zip(texts, labels, strict=True)), "text string, label int").withColumn("late", F.lit(False))
    tables = [toxicity.keyed(t) for t in toxicity.tables_of(toxicity.counts(frame).drop("late"))]
    llr = plain_kneser_ney(texts, labels)
    for text in [*texts, "a foolish damned day", "unheard zzz words é"]:
        of_words = [[llr(g) for g in word] for word in words(text)]
        sums = [sum(w) for w in of_words]
        n = sum(map(len, of_words))
        want = [sum(sums) / n, sum(max(x - toxicity.CLEAR, 0) for x in sums) / len(sums) ** 0.5, max(sums)] if n else [0, 0, 0]
        assert toxicity.figures([text], *tables)[0] == pytest.approx(want, abs=1e-5)


def test_no_two_grams_share_a_value(spark):
    """With more n-grams than 2^21 none gets another's value, and one never counted gets none."""
    n = 2_300_000
    keys, values = toxicity.keyed(spark.range(n).select(F.col("id").alias("gram"), F.col("id").cast("double").alias("llr")))
    assert len(keys) == n
    assert (toxicity.looked_up(np.arange(n, dtype=np.uint64), keys, values) == np.arange(n, dtype=np.float32)).all()
    assert np.isnan(toxicity.looked_up(np.arange(n, n + 1000, dtype=np.uint64), keys, values)).all()
    assert np.isnan(toxicity.looked_up(np.arange(3, dtype=np.uint64), keys[:0], values[:0])).all()


def test_counts_cover_the_curves_fold(spark):
    """A toxic expression whose labelled documents all lie in fold 4 is known to the model."""
    ids = spark.range(3000).select(F.col("id").alias("doc_id"), F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5)).alias("fold"))
    fold4 = sorted(r.doc_id for r in ids.where("fold = 4").collect())[:30]
    toxic, ordinary = "the weather gruzzip was fine today", "the weather morning was fine today"
    texts = [(i, f"the weather {'zorblax' if i % 2 else 'morning'} was fine today", i % 2) for i in range(300) if i not in fold4]
    texts += [(i, toxic if k % 2 else ordinary, k % 2) for k, i in enumerate(fold4)]
    new = spark.createDataFrame([(90001, toxic), (90002, ordinary)], "doc_id long, text string")
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string").union(new)
    labels = spark.createDataFrame([(i, t) for i, _, t in texts], "doc_id long, toxic int")
    llr = {r.doc_id: r.llr for r in toxicity.toxicity_scores(docs, labels).where("doc_id > 90000").collect()}
    assert llr[90001] > 0.1 and llr[90002] < -0.1


def test_joined_figures_are_the_broadcast_ones(spark):
    """With tables above the bound of a broadcast every row, odd ones too, has the same score by a join."""
    docs, labels = (table(spark, cases.SF, t) for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text", "lang").union(cases.odd_docs(spark).select("doc_id", "text", F.lit("x").alias("lang")))
    docs = docs.withColumnRenamed("lang", "chunk")
    same = [cases.sorted_rows(toxicity.toxicity_scores(docs, labels, n).select("doc_id", "chunk", "score")) for n in (1 << 40, 0)]
    assert len(same[0]) == docs.count() and same[0] == same[1]
    assert toxicity.toxicity_scores(docs.limit(0), labels, 0).count() == 0


def test_joined_figures_of_small_chunks(spark, monkeypatch):
    """Chunks of a few bytes, and a hot text, give the figures of one table that holds all."""
    frame = spark.createDataFrame([("you fool", 1), ("fine day", 0), ("foolish fine day", 1)], "text string, label int").withColumn("late", F.lit(False))
    seen, new = toxicity.tables_of(toxicity.counts(frame).drop("late"))
    texts = ["you fool"] * 50 + ["a foolish day", "", None, "unheard zzz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = toxicity.figures(texts, toxicity.keyed(seen), toxicity.keyed(new))
    for limit, in_range, asked in ((10, 1 << 20, 256), (10, 7, 3), (1 << 20, 7, 256)):
        monkeypatch.setattr(toxicity, "ASKED", asked)
        got = sorted(tuple(r) for r in toxicity.joined_figures(docs, seen, new, limit=limit, in_range=in_range).collect())
        assert [r[0] for r in got] == list(range(len(texts)))
        assert np.array([r[1:] for r in got]) == pytest.approx(want, abs=1e-6)
