"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

Each source has a target number of words. A document is wanted target / size-of-source times: whole copies, and a
fractional probability. Probabilities are rounded by the pivotal method: a pair of documents exchanges mass at random
until one of the two is taken or left out, and the other goes on with what remains. Mass is counted in words, so a source's
expected words stay as they are through every exchange. Documents are dealt out to small groups by hash; each group passes
one open document on, groups of these do the same, and so on up a tree until a source has one left, which is drawn.

Documents are rounded in tiers, from those that are large against their source's target to the small ones. What the
rounding of the larger ones left too much or too little is made up for by the probabilities of the rest. So a source
misses its target by about one document of its last tier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.shared import owned, written
from quern.sources.tables import table

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents in a group of the tree, on average; a group's fold copies its decisions, so it is kept small.
GROUP = 128
#: A document is in the first tier above target / TIERS[0] words, in the second above target / TIERS[1], and so on.
TIERS = (8, 32, 128)
SEED = 6
#: Rows that a task makes of one repeated row; more are dealt out.
AT_ONCE = 4096
WORDS = r"[^\x20\x09-\x0D]+"
TINY = 1e-9


def targets(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources by code point, null last, have the weights in turn and share the sum of all sizes; a target stops at `most`
    times its source's size. All targets below their bound are a common multiple of their weights, so that multiple is
    found with the sources in the order in which they reach their bounds. One row a source, which a single task sorts.
    """
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("bound", float(most) * F.col("source_size"))
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every)
    left = total - F.coalesce(F.sum("bound").over(upto), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.greatest(left, F.lit(0.0)) / weight_left
    sources = sources.withColumn("level", level).withColumn("turn", F.row_number().over(order))
    free = F.col("level") * F.col("weight") <= F.col("bound")
    common = F.min(F.when(free, F.struct("turn", "level"))).over(every)["level"]
    target = F.coalesce(F.least(F.col("bound"), common * F.col("weight")), F.col("bound"))
    return sources.select("source", "source_size", target.cast("double").alias("target"))


def chance(*columns: Column) -> Column:
    """A number from 0 to 1 that depends on the columns only."""
    return F.pmod(F.xxhash64(F.lit(SEED), *columns), F.lit(1 << 52)) / float(1 << 52)


def folded(items: Column) -> Column:
    """The open document that remains of a group, and what was decided on the way.

    items: array of (id, size, p), sizes above 0. Of the open one a and the next one b, mass of min((1 - p_a) size_a,
    p_b size_b) can go to a, or of min(p_a size_a, (1 - p_b) size_b) to b; which, is drawn so that both keep their
    expectation. Then one of them is at 0 or 1.
    """
    item = "struct<id:string,size:double,p:double>"
    start = F.struct(F.lit(None).cast(item).alias("open"), F.array().cast("array<struct<id:string,take:boolean>>").alias("done"))

    def step(state: Column, b: Column) -> Column:
        a = state["open"]
        to_a = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
        to_b = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
        up = chance(a["id"], b["id"]) * (to_a + to_b) < to_b
        p_a = F.when(up, a["p"] + to_a / a["size"]).otherwise(a["p"] - to_b / a["size"])
        p_b = F.when(up, b["p"] - to_a / b["size"]).otherwise(b["p"] + to_b / b["size"])
        moved = F.array(F.struct(a["id"].alias("id"), a["size"].alias("size"), p_a.alias("p")), F.struct(b["id"].alias("id"), b["size"].alias("size"), p_b.alias("p")))
        return F.aggregate(moved, F.struct(F.lit(None).cast(item).alias("open"), state["done"].alias("done")), settle)

    def settle(state: Column, x: Column) -> Column:
        closed = (x["p"] < TINY) | (x["p"] > 1 - TINY) | state["open"].isNotNull()
        taken = F.struct(x["id"].alias("id"), (x["p"] > 0.5).alias("take"))
        return F.struct(
            F.when(closed, state["open"]).otherwise(x).cast(item).alias("open"),
            F.when(closed, F.concat(state["done"], F.array(taken))).otherwise(state["done"]).alias("done"),
        )

    return F.aggregate(items, start, lambda state, b: F.when(state["open"].isNull(), settle(state, b)).otherwise(step(state, b)))


def rounded(items: DataFrame, group: int = GROUP) -> DataFrame:
    """(key, take) for the items (source, key, size, p) with 0 < p < 1 and size > 0; keys are unique texts.

    Each level of the tree deals the open documents of a source out to groups of about `group` and folds them, until
    every source has one group.
    """
    now = items
    done = None
    while True:
        most = now.groupBy("source").agg(F.count("*").alias("n"))
        parts = most.select("source", F.ceil(F.col("n") / float(group)).alias("parts"))
        last = parts.agg(F.max("parts").alias("n")).first().n or 0
        grouped = now.join(parts.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        grouped = grouped.groupBy("source", F.pmod(F.xxhash64(F.lit(SEED), "key"), "parts").alias("part"))
        listed = F.array_sort(F.collect_list(F.struct(F.col("key").alias("id"), F.col("size"), F.col("p"))))
        level = written(grouped.agg(folded(listed).alias("s")).select("source", "s.*"))
        decided = level.select(F.explode("done").alias("d")).select(F.col("d.id").alias("key"), F.col("d.take").alias("take"))
        done = decided if done is None else done.union(decided)
        now = level.where("open is not null").select("source", F.col("open.id").alias("key"), F.col("open.size").alias("size"), F.col("open.p").alias("p"))
        if last <= 1:
            return done.union(now.select("key", (chance(F.col("key"), F.lit("last")) < F.col("p")).alias("take")))


def copies(items: DataFrame, share: Column) -> DataFrame:
    """`items` with `copies`: the whole part of `share`, and one more where the rest is rounded up."""
    split = items.withColumn("share", share).withColumn("whole", F.floor(F.col("share") + TINY)).withColumn("p", F.greatest(F.col("share") - F.col("whole"), F.lit(0.0)))
    split = written(split)
    open_ = split.where(f"p > {TINY} and size > 0").select("source", "key", F.col("size").cast("double").alias("size"), "p")
    # keys grow with the documents: not broadcast, however few they are
    return split.join(rounded(open_).hint("merge"), "key", "left").withColumn("copies", (F.col("whole") + F.coalesce(F.col("take").cast("int"), F.lit(0))).cast("int")).drop("share", "whole", "p", "take")


def compared(docs: DataFrame) -> list[str]:
    """The columns that rows are compared by: all that Spark hashes, so none with maps."""
    return [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]


def sized(docs: DataFrame, *kept: Column) -> DataFrame:
    """doc_id, source, size (words of the text) and variant, with what is kept. Rows alike in all columns share a variant.

    Columns with maps, which Spark does not hash, are left out of that comparison.
    """
    columns = [F.col(f"`{c}`") for c in compared(docs)]
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    who = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    variant = F.concat_ws(":", who, F.xxhash64(*columns), F.hash(*columns))
    return docs.select(*kept, "doc_id", "source", size.alias("size"), variant.alias("variant"))


def repeated(rows: DataFrame, n: str, largest: int) -> DataFrame:
    """Each row of `rows` n times, numbered by `copy`; where a row repeats more than AT_ONCE times, its pieces go to many tasks.

    largest: the largest value of the column n.
    """
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(AT_ONCE).cast("long"))))
    if largest > AT_ONCE:
        pieces = pieces.repartition("variant", "piece")
    return pieces.withColumn("copy", F.explode(F.sequence("piece", F.least(F.col("piece") + AT_ONCE, F.col(n)) - 1))).drop("piece", n)


@owned
def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(doc_id, variant, copy, size, source, source_size, target, copies) of every row of `docs`, which has doc_id, source, text.

    size: words of the whole text, 0 for a null. copies: how often the mix takes the document, from 0 to `most`. Rows that
    share a doc_id, or have none, are documents of their own; those alike in all columns share a variant and are numbered
    by copy. They are counted before any shuffle of rows, so one id or row on a large share of the table is nobody's burden.
    Documents without words are taken no times beyond the whole part of their share. A source without words has the
    target 0. An empty table stays empty.
    """
    rows = written(sized(docs).groupBy("variant", "doc_id", "source", "size").agg(F.count("*").alias("n")))
    largest = rows.agg(F.max("n")).first()[0] or 0
    # one row a source; spread over the rows by a join on the source that is split where a source is hot
    goals = written(targets(rows.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most))
    of = goals.withColumnRenamed("source", "of")
    items = rows.join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    tier = sum((F.col("size") * b <= F.col("target")).cast("int") for b in TIERS)
    items = repeated(items.withColumn("tier", tier), "n", largest).withColumn("key", F.concat_ws(":", "variant", "copy"))
    done = None
    for t in range(len(TIERS) + 1):
        now = items.where(F.col("tier") == t)
        have, of_done = F.lit(0), F.lit(0)
        if done is not None:
            sums = done.groupBy(F.col("source").alias("of")).agg(F.sum(F.col("size") * F.col("copies")).alias("have"), F.sum("size").alias("of_done"))
            now = now.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
            have, of_done = F.coalesce("have", F.lit(0)), F.coalesce("of_done", F.lit(0))
        left = F.col("source_size") - of_done
        share = F.when(left > 0, (F.col("target") - have) / left).otherwise(0.0)
        found = copies(now, F.least(F.greatest(share, F.lit(0.0)), F.lit(float(most)))).drop("have", "of_done")
        found = written(found, kept=True)
        done = found if done is None else done.unionByName(found)
    return done.drop("tier", "key")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 6."""
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")
