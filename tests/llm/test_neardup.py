import random

from llm import cases
from pyspark.sql import functions as F

from quern.llm import neardup
from quern.llm.shared import over_texts


def brute(rows):
    def shingles(text):
        for c in "\t\n\x0b\x0c\r":
            text = (text or "").replace(c, " ")
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split(" ")
        w = [x for x in w if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    group = {i: i for i, _ in rows}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                lo, hi = sorted((top(i), top(j)))
                group[hi] = lo
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets)


def made(seed, families=12, size=6):
    rnd = random.Random(seed)
    rows = []
    for _ in range(families):
        words = [f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(8, 120))]
        for _ in range(size):
            other = [w if rnd.random() > 0.03 else f"v{rnd.randrange(4000)}" for w in words]
            rows.append((len(rows) * 3 + 1, " ".join(other)))
    rnd.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = made(3) + [(9001, "Same Words here"), (9002, "same words\there"), (9003, ""), (9004, None), (9005, "a b c d e"), (9006, "a b c d e")]
    assert cases.sorted_rows(neardup.near_duplicates(cases.docs(spark, rows))) == sorted(brute(rows), key=lambda r: tuple((True, str(x)) for x in r))


def templated(n, seed=1):
    """Documents of one template, two thirds of their shingles the same, and some copies with a changed word: (id, text)."""
    rnd = random.Random(seed)
    frame = " ".join(f"frame{i}" for i in range(200))
    rows = [(i, f"{frame} " + " ".join(f"own{i}x{j}" for j in range(80))) for i in range(n)]
    return rows + [(n + i, rows[i][1].replace(f"own{i}x{rnd.randrange(80)}", "other")) for i in range(0, n, 10)]


def test_split_buckets_lose_no_link(spark):
    """Every open bucket is dealt out by rarest shingles: the same classes."""
    rows = made(4) + [(i + 5000, t) for i, t in templated(60)]
    docs = cases.docs(spark, rows)
    whole = cases.sorted_rows(neardup.near_duplicates(docs))
    assert whole == cases.sorted_rows(neardup.near_duplicates(docs, split=0)) == sorted(brute(rows), key=lambda r: tuple((True, str(x)) for x in r))


def test_rarest_shingles_keep_tests_in_proportion(spark):
    """In a bucket of n classes of one template, tests by the bucket grow with n squared, by rarest shingles with n."""

    def tests(opened):
        counts = opened.groupBy("u").agg(F.count("*").alias("n"), F.sum((F.col("class") != F.col("main")).cast("int")).alias("other"))
        return counts.agg(F.sum(F.col("n") * F.col("other"))).first()[0] or 0

    found = []
    for n in (100, 400):
        frame = over_texts(spark.createDataFrame(templated(n), "id long, text string"), "text", neardup.full_set, "found binary, size long, " + ", ".join(f"p{i} long" for i in range(16)))
        members = frame.selectExpr("id", "id as class")
        found.append((tests(neardup.open_buckets(members.withColumn("u", F.lit(0)))), tests(neardup.open_buckets(neardup.rarest(members, frame)))))
    (whole_1, rare_1), (whole_4, rare_4) = found
    assert whole_4 > 15 * whole_1 and rare_4 < 5 * rare_1 and rare_4 < whole_4 / 10


def test_bound_loses_no_link(spark):
    """All documents in one bucket, each a class of its own: every link passes the bound, and most other pairs do not."""
    rows = made(5, families=8, size=4)
    sets = {i: set(neardup.shingle_sets([t])[0].tolist()) for i, t in rows}
    frame = over_texts(spark.createDataFrame(rows, "id long, text string"), "text", neardup.full_set, "found binary, size long, " + ", ".join(f"p{i} long" for i in range(16)))
    found = {tuple(r) for r in neardup.open_pairs(frame.selectExpr("id", "id as class", "0L as u", "1L as main"), frame).collect()}
    links = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert links <= found and len(found) < len(links) + 20


def test_open_buckets(spark):
    """Buckets of one class are left out; of others the largest class is the main one, and pairs come once."""
    members = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 4, 0), (5, 5, 0), (6, 6, 1), (7, 6, 1)], "id long, class long, u long")
    opened = neardup.open_buckets(members)
    assert {(r.id, r.main) for r in opened.collect()} == {(i, 1) for i in range(1, 6)}
    text = " ".join(f"w{i}" for i in range(30))
    sets = over_texts(spark.createDataFrame([(i, text) for i in range(1, 8)], "id long, text string"), "text", neardup.full_set, "found binary, size long, " + ", ".join(f"p{i} long" for i in range(16)))
    assert cases.sorted_rows(neardup.open_pairs(opened, sets)) == [(i, j) for i, j in ((1, 4), (1, 5), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5))]


def test_ids_with_several_texts(spark):
    """An id's texts are one document: through it, what is near the one is linked with what is near the other."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (9, b + " more"), (11, b), (20, "else"), (20, "other")]
    found = cases.sorted_rows(neardup.near_duplicates(cases.docs(spark, rows)).select("doc_id", "component_id"))
    assert found == sorted([(3, 3), (5, 3), (5, 3), (9, 3), (11, 3), (20, 20), (20, 20)], key=lambda r: str(r[0]))


def test_chain_is_one_class(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)], "a long, b long")
    found = dict(map(tuple, neardup.components(links).collect()))
    assert found == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def test_odd_rows(spark):
    rows = cases.sorted_rows(neardup.near_duplicates(cases.odd_docs(spark).withColumn("digest", F.lit(1))))
    assert len(rows) == 9
    by = {r[0]: r for r in rows}
    assert by[1] == (1, 0, 1, True) and by[2] == (2, 0, 2, True) and by[3] == (3, 0, 3, True)
    assert by[5] == (5, 1, 5, True) and by[None][2:] == (None, True) and by[4][1] > 900
    assert neardup.near_duplicates(cases.docs(spark, [])).count() == 0


def test_against_sql(spark):
    cases.against_sql(spark, neardup.op9_near_duplicates, neardup.ORACLE_SQL)
