from llm import cases
from pyspark.sql import functions as F

from quern.llm import urlfilter


def judged(spark, urls, labels=()):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    known = spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")
    return {r.page_id: r for r in urlfilter.judged(pages, known).collect()}


def test_rules(spark):
    urls = ["http://A.example.NET/en/1", "http://example.net/de/", "http://x.net", "https://b.example.com/de/?q", "http://notexample.com/de/", "http://org/fr/", "http://x.org/FR/", None, "no host", "ftp://h:80?x://y/z", "a://b://c/d#e"]
    found = judged(spark, urls)
    assert [found[i].rule for i in range(len(urls))] == ["example.net/en/", "net/", None, "example.com/de/", None, "org/fr/", None, None, None, None, None]
    assert [found[i].verdict for i in range(7)] == ["allow", "block", "allow", "block", "allow", "allow", "allow"]
    assert (found[0].host, found[0].path) == ("a.example.net", "/en/1") and (found[7].host, found[8].path) == ("", "")
    assert (found[9].host, found[9].path) == ("h:80", "") and (found[10].host, found[10].path) == ("b:", "//c/d")


def test_long_urls(spark):
    """Hosts and paths of a megabyte are taken whole."""
    host, path = "A" * 500_000 + ".example.net", "/en/" + "x/" * 250_000
    found = judged(spark, [f"http://{host}{path}?q", "http://" + "/" * 10**6, "x" * 10**6])
    assert (found[0].host, found[0].path, found[0].rule) == (host.lower(), path, "example.net/en/")
    assert (found[1].host, found[1].path) == ("", "/" * 10**6) and found[2].host == ""


def test_reputation(spark):
    """A host with bad pages only is blocked, one like it with few pages is drawn to its domain, a good one is allowed."""
    urls = [f"http://bad.one.com/{i}" for i in range(40)] + [f"http://good.two.com/{i}" for i in range(40, 80)] + ["http://new.two.com/80", "http://unseen.com/x"]
    labels = [(i, 0 if i < 40 else 1, 0) for i in range(80)] + [(80, 0, 0)]
    found = judged(spark, urls, labels)
    assert {found[i].verdict for i in range(40)} == {"block"} and {found[i].verdict for i in range(40, 82)} == {"allow"}


def test_unlabelled_host_is_judged_by_its_nearest_level(spark):
    """A fresh subdomain of a domain with bad pages only is blocked, one of a good domain and an unknown suffix are allowed."""
    urls = [f"http://h{i % 50}.bad.com/{i}" for i in range(1000)] + [f"http://h{i % 50}.good.org/{i}" for i in range(1000, 2000)]
    found = judged(spark, urls + ["http://fresh.bad.com/x", "http://fresh.good.org/x", "http://a.b.info/x", "http://a.new.org/x"], [(i, 0 if i < 1000 else 1, 0) for i in range(2000)])
    assert [found[2000 + i].verdict for i in range(4)] == ["block", "allow", "allow", "allow"]
    assert found[2001].lower is not None and found[2002].lower is not None and found[2003].lower is not None


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None), (None, "http://a.b/1"), (2, ""), (2, "")], "page_id long, url string").withColumn("verdict", F.lit("x")).withColumn("lower", F.lit("y"))
    labels = spark.createDataFrame([(1, None, None), (None, 0, 1), (1, 0, None), (1, 0, None)], "doc_id long, quality int, toxic int")
    assert urlfilter.judged(pages, labels).count() == 4
    assert urlfilter.judged(pages, labels.limit(0)).where("verdict = 'allow'").count() == 4
    assert urlfilter.judged(pages.limit(0), labels).count() == 0


def test_against_sql(spark):
    cases.against_sql(spark, urlfilter.op10_url_filter, urlfilter.ORACLE_SQL)


def test_bounds_against_sql(spark):
    """The bounds themselves, of hosts known and unknown, against the SQL's."""
    import duckdb

    urls = [f"http://h{i % 9}.d{i % 3}.x{i % 2}/{i}" for i in range(400)] + ["http://new.d0.x0/a", "http://a.new.x1/", "http://a.b.c/", "http://h1.d1.x1/b"]
    labels = [(i, int((i * 7) % 9 < 4), int(i % 11 == 0)) for i in range(400)]
    got = {i: r.lower for i, r in judged(spark, urls, labels).items()}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    cut = urlfilter.ORACLE_SQL.index("    SELECT page_id, host, path, rule, CASE\n        WHEN rule IN")
    want = con.execute(urlfilter.ORACLE_SQL[:cut] + f"SELECT page_id, mean - {urlfilter.Z} * sqrt(mean * (1 - mean) * share) FROM known").fetchall()
    assert len(want) == len(got) and all(abs(got[i] - x) < 1e-9 for i, x in want)
