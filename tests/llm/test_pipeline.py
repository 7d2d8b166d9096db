"""Each stage of the pipeline against a plain version of it, on its own input."""

import pytest
from llm import cases
from pyspark.sql import functions as F

import corpus_pipeline as p
from quern.llm import decontaminate, linededup, mixing, neardup, quality
from quern.llm.shared import written
from quern.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark):
    sf, docs = cases.SF, table(spark, cases.SF, "documents")
    assert [n for n, _ in p.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights"]

    out = written(p.quality_stage(spark, docs, sf))
    assert out.columns == COLUMNS
    scores = quality.op8_quality(spark, sf).where("predicted = 1")
    assert ids(out) == ids(scores)
    assert cases.sorted_rows(out) == cases.sorted_rows(docs.join(scores.select("doc_id"), "doc_id", "left_semi"))

    docs, out = out, written(p.line_dedup_stage(spark, out, sf))
    assert out.columns == COLUMNS
    text = {r.doc_id: r.text for r in linededup.line_dedup(docs).collect() if not r.n_dropped or (r.text or "").strip()}
    assert {r.doc_id: r.text for r in out.collect()} == text
    assert out.where("n_chars != length(text)").count() == 0

    docs, out = out, written(p.near_duplicates_stage(spark, out, sf))
    assert out.columns == COLUMNS
    classes = {}
    for r in neardup.near_duplicates(docs).collect():
        classes.setdefault(r.component_id, []).append(r.doc_id)
    assert ids(out) == sorted(min(c) for c in classes.values())

    docs, out = out, written(p.decontamination_stage(spark, out, sf))
    assert out.columns == COLUMNS
    found = decontaminate.contamination(docs, table(spark, sf, "benchmark"))
    assert ids(out) == sorted(r.doc_id for r in found.collect() if not (r.n_hit and 20 * r.n_hit >= r.n_words))

    docs, out = out, p.mix_stage(spark, out, sf)
    assert out.columns == [*COLUMNS, "copies"]
    want = {r.doc_id: r.copies for r in mixing.mixed(docs).collect() if r.copies}
    assert {r.doc_id: r.copies for r in out.collect()} == want


def test_run_is_the_stages_in_turn(spark):
    docs = table(spark, cases.SF, "documents")
    for _, stage in p.STAGES:
        docs = written(stage(spark, docs, cases.SF))
    assert cases.sorted_rows(docs) == cases.sorted_rows(p.run(spark, cases.SF))


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_odd_rows(spark, name, stage):
    odd = cases.odd_docs(spark)
    for c in ("whole", "score", "copies", "row", "gone", "n_dropped", "carried", "size", "key", "a b"):
        odd = odd.withColumn(c, F.lit(1))
    out = stage(spark, odd, cases.SF)
    assert set(out.columns) == set(odd.columns)
    assert out.count() <= odd.count() * 3
    assert stage(spark, odd.limit(0), cases.SF).count() == 0
    if name == "MinHash near-dedup":
        assert ids(out.where("doc_id is not null")) == [1, 2, 3, 4, 5, 7, 8] and out.where("doc_id is null").count() == 1


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_map_and_array_columns(spark, name, stage):
    """Columns that Spark does not hash or order, with ids that repeat."""
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words), (1, words + " more"), (1, words), (2, None), (2, ""), (None, "a b c d e f"), (None, "a b c d e f")]
    docs = cases.docs(spark, rows).withColumn("m", F.create_map(F.lit("k"), F.col("text"))).withColumn("a", F.array("text", "lang")).withColumn("s", F.struct(F.col("m").alias("in"), "doc_id"))
    out = stage(spark, docs, cases.SF)
    assert set(docs.columns) <= set(out.columns)
    found = out.collect()
    assert len(found) <= 3 * len(rows) and all(r.m == {"k": r.text} or name == "line dedup" for r in found)
    if name == "MinHash near-dedup":
        assert sorted((r.doc_id or 0, r.text or "") for r in found)[1:] == [(1, next(r.text for r in found if r.doc_id == 1)), (2, ""), (2, "")]


def test_run_leaves_only_what_its_result_reads(spark):
    import os

    from quern.llm import shared

    shared.clear()
    path = shared.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(path))
    out = p.run(spark, cases.SF)
    read = {part for f in out.inputFiles() for part in f.split("/") if part.startswith("quern-")}
    assert {x for x in set(os.listdir(path)) - before if x.startswith("quern-")} == read
    shared.clear()


def test_near_duplicates_by_row(spark):
    """One row of each class stays: of repeated rows, of null ids, of an id with several texts."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b + " more"), (None, a), (None, c), (None, c), (30, ""), (30, ""), (None, None), (7, "alone here"), (7, "alone here")]
    out = p.near_duplicates_stage(spark, cases.docs(spark, rows), cases.SF)
    assert cases.sorted_rows(out.select("doc_id", "text")) == cases.sorted_rows(cases.docs(spark, [rows[i] for i in (0, 5, 7, 8, 9, 10)]).select("doc_id", "text"))


def test_large_groups(spark):
    """A third of all documents are copies, another third share a line: one of the copies stays, and the line once."""
    rows = [(i, " ".join(f"copy{j}" for j in range(30))) for i in range(1, 401)]
    rows += [(400 + i, f"a line that many documents share word for word\n{' '.join(f'own{i}x{j}' for j in range(20))}") for i in range(1, 401)]
    rows += [(800 + i, " ".join(f"other{i}y{j}" for j in range(20))) for i in range(1, 401)]
    docs = cases.docs(spark, rows)
    assert ids(p.near_duplicates_stage(spark, docs, cases.SF)) == [1, *range(401, 1201)]
    lines = p.line_dedup_stage(spark, docs, cases.SF)
    assert ids(lines.where("doc_id <= 400")) == [1] and ids(lines.where(F.col("text").contains("many documents"))) == [401]


def test_mix_takes_each_row_by_itself(spark):
    """Rows of one id that differ in any column leave as they came; the mix's row counts are those of its operator."""
    rows = [(1, "a b c", "s")] * 30 + [(1, f"d{i} e f", "s") for i in range(30)] + [(None, "g h", "t")] * 20 + [(9, None, "t")]
    docs = cases.docs(spark, rows).withColumn("lang", F.when(F.rand(1) < 0.5, "en").otherwise("de"))
    docs = written(docs)
    out = p.mix_stage(spark, docs, cases.SF)
    got = out.groupBy(*COLUMNS, "copies").count().withColumnRenamed("count", "n")
    came = docs.groupBy(*COLUMNS).count()
    held = got.groupBy(*COLUMNS).agg(F.sum("n").alias("n")).alias("got")
    held = held.join(came.alias("came"), [F.col(f"got.{c}").eqNullSafe(F.col(f"came.{c}")) for c in COLUMNS])
    assert held.where("n > count").count() == 0 and held.count() == got.select(*COLUMNS).distinct().count()
    want = mixing.mixed(docs).where("copies > 0").groupBy("doc_id", "copies").count().orderBy("doc_id", "copies").collect()
    assert out.groupBy("doc_id", "copies").count().orderBy("doc_id", "copies").collect() == want
