"""Small tables with the cases that every operator must take: nulls, empty and long texts, repeated rows, clashing names."""

import duckdb

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """documents from (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] else None) for r in rows]
    return spark.createDataFrame(full, DOC)


def odd_docs(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return docs(spark, [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "one two"), (5, "one two"), (None, "three four five six seven eight"), (7, "É ß 漢字 😀 <|endoftext|>"), (8, "x", None)])


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


def against_sql(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = query(spark, sf)
    columns = sorted(got.columns)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((key(r) for r in got.select(*columns).collect())) == sorted(key([r[i] for i in place]) for r in want.fetchall())
