"""Line dedup with a log-template tree of fixed depth. DataFrame functions only.

A line's words are masked first: one with a digit becomes <*>. The tree's first level is the number of words, its next ones
are the leading words, up to three and a third of the line at most; a leaf holds the lines that agree in these. A leaf may
hold any number of templates. For each word and place of a leaf its support is counted, the distinct lines that have the
word there. The leaf's main template has the words that more than half of its lines share, and the lines that agree with
these at SIMILAR of their places or more. Any other line sorts its own places by support; so many of the best supported as
make up SIMILAR of its places are constant, with all others that have as much support, and the rest are variable fields.
All lines of one template share its constant words, so these have one support, which neither the leaf's other lines nor
other templates change, while the words in its fields have less. Lines with the same words in the same constant places are
one template; a line whose constants only it has is a template of its own. A template that recurs across documents is
dropped from all of them but the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import apart, owned, removed, together, written
from quern.sources.tables import table

#: A template recurs if so many documents have it: one of over LONG words, of fewer than SHORT ones, any other.
MIN_DOCS_LONG, MIN_DOCS_SHORT, MIN_DOCS = 2, 10, 3
LONG, SHORT = 50, 5
#: The share of a line's places that are constant at least. Below 4 words that is every place.
SIMILAR, LEAST = 0.7, 4
DEPTH = 3


def tidy(line: Column) -> Column:
    """The line with single blanks. Few lines have others, and looking for a text is much cheaper than a pattern."""
    odd = line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\x0b") | line.contains("\x0c")
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x09-\x0D\x20]+", " ")).otherwise(line))


def masked(line: Column) -> Column:
    """The line with words that have digits as <*>."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(line)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, n, line, key, leaf): the masked lines that are not blank. row stands for the id and the whole text."""
    row = F.xxhash64("doc_id", "text").alias("row")
    # all is done before the lines are exploded, each step once a line, so that later expressions do not repeat it
    clean = F.transform(F.transform(F.split("text", "\n"), tidy), masked)
    counted = F.transform(clean, lambda line: F.struct(line.alias("line"), F.size(F.split(line, " ")).alias("n")))
    found = docs.select("doc_id", row, F.posexplode(counted).alias("pos", "l")).select("doc_id", "row", "pos", "l.n", "l.line").where("line != ''")
    return hashed(found)


def hashed(found: DataFrame) -> DataFrame:
    """`found`, which has n and line, with their hash as key and that of the leaf."""
    leaf = F.expr(f"xxhash64(n, substring_index(line, ' ', int(least({DEPTH}, greatest(1, n div 3)))))")
    return found.withColumn("key", F.xxhash64("n", "line")).withColumn("leaf", leaf)


def generalised(found: DataFrame) -> DataFrame:
    """(key, general) of the lines that share words with others of their leaf, as a written table; general stands for the template.

    found: a written table of lines().
    """
    place = F.xxhash64("row", "pos").alias("at")
    # one occurrence of each distinct line, of leaves that have several; numbers only
    distinct = written(found.where(f"n >= {LEAST}").select("leaf", "key", place).groupBy("leaf", "key").agg(F.min("at").alias("at")))
    several = written(distinct.groupBy("leaf").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least != most").select("leaf"))
    chosen = distinct.join(several, "leaf", "left_semi").select("at")
    text = found.where(f"n >= {LEAST}").select("n", place, "line").join(chosen, "at", "left_semi").distinct()
    words = written(hashed(text).select("leaf", "key", "n", F.posexplode(F.split("line", " ")).alias("place", "word")).withColumn("word", F.xxhash64("word")))
    support = written(words.groupBy("leaf", "place", "word").agg(F.count("*").alias("support")).where("support > 1"))
    supported = words.join(support, ["leaf", "place", "word"]).select("leaf", "key", "n", F.struct("place", "word", "support").alias("w"))
    # a line's own words; the first one's support is that of the leaf
    supported = supported.groupBy("leaf", "key", "n").agg(F.array_sort(F.collect_list("w")).alias("w")).withColumn("enough", F.ceil(F.col("n") * SIMILAR).cast("int"))
    supported = supported.where(F.size("w") >= F.col("enough"))
    is_main = F.size(F.filter("w", lambda w: 2 * w["support"] > F.col("w")[0]["support"])) >= F.col("enough")
    bar = F.sort_array(F.transform("w", lambda w: w["support"]), asc=False)[F.col("enough") - 1]
    constant = F.transform(F.filter("w", lambda w: w["support"] >= F.col("bar")), lambda w: F.struct(w["place"], w["word"]))
    supported = supported.select("leaf", "key", "w", bar.alias("bar"), is_main.alias("is_main"))
    general = written(supported.select("key", F.when(F.col("is_main"), F.xxhash64("leaf")).otherwise(F.xxhash64("leaf", constant)).alias("general")))
    removed(distinct, several, words, support)
    return general


@owned
def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_docs_short: int = MIN_DOCS_SHORT, min_docs_long: int = MIN_DOCS_LONG) -> DataFrame:
    """`docs` with the recurring lines gone from text, and with n_lines and n_dropped.

    docs: doc_id, text and any other columns; those of the names made are replaced. Blank lines stay. A null text stays
    null with 0 lines; an empty one has one blank line. Texts and lines are taken whole, however long. Rows that repeat, id
    and text, count as one document and are treated alike; of documents with one id the order is that of a hash of their
    texts, and a null id comes first. An empty table stays empty.
    """
    docs, rest = apart(docs, "doc_id", "text")
    found = written(lines(docs))
    general = generalised(found)
    placed = found.select("doc_id", "row", "pos", "n", "key").join(general, "key", "left")
    placed = written(placed.select("doc_id", "row", "pos", "n", F.coalesce("general", "key").alias("template")), kept=True)
    removed(found, general)
    by_doc = placed.groupBy("template", "n", "doc_id", "row").agg(F.lit(1).alias("one"))
    often = by_doc.groupBy("template", "n").agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "row")).alias("first"))
    enough = F.when(F.col("n") < SHORT, min_docs_short).when(F.col("n") > LONG, min_docs_long).otherwise(min_docs)
    often = written(often.where(F.col("n_docs") >= enough).select("template", F.col("first.row").alias("first_row")), kept=True)
    drops = placed.select("template", "row", "pos").join(often, "template").where("row != first_row")
    drops = drops.groupBy("row").agg(F.collect_set("pos").alias("drop"))
    found = docs.withColumn("row", F.xxhash64("doc_id", "text")).join(drops, "row", "left").drop("row")
    parts = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "drop")
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    # counted without cutting the text up
    found = found.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long"))
    found = found.withColumn("n_dropped", F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long"))
    return together(found.withColumn("text", text), rest, "doc_id", "text", "n_lines", "n_dropped")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text."""
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


ORACLE_SQL = f"""
    WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
    raw AS (SELECT doc_id, unnest(parts) AS line, unnest(range(0, len(parts))) AS pos FROM split),
    clean AS (SELECT doc_id, pos, trim(regexp_replace(line, '[\\x09-\\x0D\\x20]+', ' ', 'g')) AS line FROM raw),
    lines AS (
        SELECT *, string_split(line, ' ') AS w, len(string_split(line, ' ')) AS n
        FROM (SELECT doc_id, pos, regexp_replace(line, '[^ 0-9]*[0-9][^ ]*', '<*>', 'g') AS line FROM clean) WHERE line <> ''),
    leaves AS (SELECT DISTINCT n, w[1:least({DEPTH}, greatest(1, n // 3))] AS lead, line, w FROM lines WHERE n >= {LEAST}),
    words AS (SELECT n, lead, line, unnest(w) AS word, unnest(range(1, n + 1)) AS place FROM leaves),
    supports AS (SELECT n, lead, place, word, count(*) AS support FROM words GROUP BY n, lead, place, word),
    supported AS (
        SELECT n, line, list({{'p': place, 'w': word, 's': support}} ORDER BY place) AS l, list(support ORDER BY support DESC) AS s
        FROM words JOIN supports USING (n, lead, place, word) GROUP BY n, line),
    barred AS (
        SELECT *, s[CAST(ceil(n * {SIMILAR}) AS INTEGER)] AS bar,
            len([x for x in s if 2 * x > l[1].s]) >= ceil(n * {SIMILAR}) AS is_main
        FROM supported),
    general AS (
        SELECT line, CASE WHEN is_main THEN array_to_string([x.w for x in l][1:least({DEPTH}, greatest(1, n // 3))], ' ') || chr(10) || n
            ELSE array_to_string([CASE WHEN x.s >= bar THEN x.w ELSE chr(10) END for x in l], ' ') END AS general
        FROM barred WHERE bar > 1),
    placed AS (SELECT l.doc_id, l.pos, l.n, coalesce(general, l.line) AS template FROM lines l LEFT JOIN general g ON g.line = l.line),
    often AS (
        SELECT template, n, min(doc_id) AS first_doc FROM placed GROUP BY template, n
        HAVING count(DISTINCT doc_id) >= CASE WHEN n < {SHORT} THEN {MIN_DOCS_SHORT} WHEN n > {LONG} THEN {MIN_DOCS_LONG} ELSE {MIN_DOCS} END),
    drops AS (SELECT doc_id, list(pos) AS d FROM placed JOIN often USING (template, n) WHERE doc_id <> first_doc GROUP BY doc_id)
    SELECT doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce(len(d), 0)::BIGINT AS n_dropped,
        CASE WHEN d IS NULL THEN text ELSE array_to_string([parts[i + 1] for i in range(0, len(parts)) if NOT list_contains(d, i)], chr(10)) END AS text
    FROM split LEFT JOIN drops USING (doc_id)"""
