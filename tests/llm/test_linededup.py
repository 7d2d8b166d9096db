from llm import cases
from pyspark.sql import functions as F

from quern.llm import linededup


def test_recurring_lines_stay_once(spark):
    notice = "This page was printed on 2024-05-01 at 10:33 by user17 from example"
    other = "This page was printed on 2023-01-31 at 09:00 by user4 from example"
    rows = [(1, f"first own line is here\n{notice}"), (2, f"{other}\n\nsecond own line is there"), (3, f"third  own\tline stands alone\n{notice}\nend"), (4, "end"), (5, "end")]
    found = {r.doc_id: r for r in linededup.line_dedup(cases.docs(spark, rows)).collect()}
    assert found[1].text == rows[0][1] and found[1].n_dropped == 0
    assert found[2].text == "\nsecond own line is there" and found[2].n_lines == 3
    assert found[3].text == "third  own\tline stands alone\nend" and found[4].text == "end"


def test_leaf_generalises_fields_without_digits(spark):
    rows = [(i, f"Posted in the archive by member {name} on the public news board today") for i, name in enumerate(("ann", "bob", "cleo", "dora"))]
    rows.append((9, "Posted in the morning she walked along a quiet river bank far away"))
    found = {r.doc_id: r.n_dropped for r in linededup.line_dedup(cases.docs(spark, rows)).collect()}
    assert found == {0: 0, 1: 1, 2: 1, 3: 1, 9: 0}


NAMES = "ann bob cleo dora emil fritz gina hugo ida jan".split()


def test_several_templates_in_a_leaf(spark):
    """Two templates of one leaf, each with half of its lines or fewer, among ordinary lines that share the lead."""
    one = [(i, f"Posted in the archive by member {n} on the public news board today") for i, n in enumerate(NAMES)]
    two = [(20 + i, f"Posted in the evening while {n} was still out to buy some bread") for i, n in enumerate(NAMES)]
    plain = [(40 + i, f"Posted in the {' '.join(f'w{chr(97 + i)}{chr(97 + j)}' for j in range(10))}") for i in range(25)]
    found = {r.doc_id: r.n_dropped for r in linededup.line_dedup(cases.docs(spark, one + two + plain)).collect()}
    assert {i for i, n in found.items() if n == 0} == {0, 20, *range(40, 65)}


def test_short_lines_have_fields_too(spark):
    rows = [(i, f"Posted by {n} today") for i, n in enumerate(NAMES)] + [(20 + i, f"{n} went home early") for i, n in enumerate(NAMES)]
    found = {r.doc_id: r.n_dropped for r in linededup.line_dedup(cases.docs(spark, rows)).collect()}
    assert {i for i, n in found.items() if n} == set(range(1, 10))
    assert linededup.line_dedup(cases.docs(spark, rows[1:])).where("n_dropped > 0").count() == 0  # nine documents are too few for so short a line


def test_long_lines_need_two_documents(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, f"own text here\n{passage}"), (2, f"{passage.replace('wordfa', 'other')}\nsome other text"), (3, passage[:340]), (4, passage[:340])]
    found = {r.doc_id: (r.text, r.n_dropped) for r in linededup.line_dedup(cases.docs(spark, rows)).collect()}
    assert found[1] == (rows[0][1], 0) and found[2] == ("some other text", 1) and found[3][1] == found[4][1] == 0


def test_hot_line_and_hot_leaf(spark):
    """A third of all documents share one line, another third lines of one leaf."""
    rows = [(i, "the same line in very many documents here") for i in range(3000)]
    rows += [(3000 + i, f"a leaf with very many lines for {''.join(chr(97 + (i // 26**k) % 26) for k in range(3))} and no one else") for i in range(3000)]
    rows += [(6000 + i, f"own line of {' '.join(chr(97 + (i // 26**k) % 26) for k in range(3))} stands here alone") for i in range(3000)]
    found = linededup.line_dedup(cases.docs(spark, rows))
    left = sorted(r.doc_id for r in found.where("n_dropped = 0").collect())
    assert left[:2] == [0, 3000] and found.where("n_dropped = 1 and doc_id < 6000").count() == 5998


def test_long_passage(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(i, f"own text {'abcdefg'[i]} here now\n{passage}") for i in range(5)]
    found = linededup.line_dedup(cases.docs(spark, rows))
    assert found.where(F.col("text").contains(passage)).count() == 1


def test_odd_rows(spark):
    docs = cases.odd_docs(spark).withColumn("row", F.lit(1)).withColumn("drop", F.lit(2)).withColumnRenamed("lang", "n_lines")
    found = {r.doc_id: r for r in linededup.line_dedup(docs).collect()}
    assert found[1].text is None and found[1].n_lines == 0 and found[2].text == "" and found[5].text == "one two"
    assert linededup.line_dedup(docs).count() == 9 and linededup.line_dedup(cases.docs(spark, [])).count() == 0


def test_against_sql(spark):
    cases.against_sql(spark, linededup.op7_line_dedup, linededup.ORACLE_SQL)
