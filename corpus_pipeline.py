"""From raw documents to a training mix; each stage's rows are written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Other
columns are carried along, whatever their names. Rows with a null doc_id or text go through every stage like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, linededup, mixing, neardup, quality
from quern.llm.shared import owned, ready, removed, settled, written
from quern.sources.tables import table


HAS_WORDS = r"[^\x20\x09-\x0D]"


def whole(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns of `docs`, and the struct `whole` of all."""
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))


@owned
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are judged like others, rows that repeat alike.

    Texts are judged whole, however long. An empty table stays empty; with no labels nothing goes.
    """
    scored = quality.quality_scores(whole(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") >= quality.THRESHOLD).select("whole.*")


@owned
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, from all documents but the first; documents that this leaves without text go too.

    Null and empty texts stay as they are, texts are taken whole, rows that repeat (id and text) are treated alike, of one
    id the smaller hash of a text comes first. An empty table stays empty.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = linededup.line_dedup(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("others")))
    found = found.where((F.col("n_dropped") == 0) | F.col("text").rlike(HAS_WORDS))
    made = {c: F.col(f"others.`{c}`") for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    made["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("others.n_chars"))
    return found.select(*[made[c].alias(c) for c in docs.columns])


@owned
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays, of the smallest id; null ids come behind all others.

    Documents without words are like nothing and stay. Rows that share an id are one document; of those with words that
    are kept, the one of the smallest hash stays, which maps do not enter. Texts are compared whole, however long. An empty
    table stays empty.
    """
    null_id = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)  # the same for rows of one text
    rows = whole(docs, "doc_id", "text").withColumn("who", F.coalesce(F.col("doc_id"), null_id)).drop("doc_id")
    texts = rows.select(F.col("who").alias("doc_id"), "text")
    found = settled(spark, lambda: neardup.near_duplicates(texts).select("doc_id", "n_shingles", "kept"), kept=True)
    gone = found.where("not kept").select(F.col("doc_id").alias("who")).distinct()
    left = rows.join(gone.hint("merge"), "who", "left_anti")  # not broadcast: ids that grow with the documents
    again = found.where("kept and n_shingles > 0").groupBy(F.col("doc_id").alias("who")).agg(F.count("*").alias("n")).where("n > 1").select("who", F.lit(True).alias("again"))
    if not again.isEmpty():
        again = written(again, kept=True)
        marked = left.join(again.hint("merge"), "who", "left").withColumn("again", F.col("again").isNotNull() & F.col("text").rlike(HAS_WORDS))
        of_row = F.xxhash64("text", *[F.col(f"whole.`{c}`") for c in mixing.compared(docs)])
        one = marked.where("again").groupBy("who").agg(F.min_by("whole", of_row).alias("whole"))
        left = marked.where("not again").select("whole").union(one.select("whole"))
    return left.select("whole.*")


@owned
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; null and empty texts have no words and stay, rows that repeat are judged alike.

    Texts are searched whole, however long. An empty table stays empty, an empty benchmark contaminates nothing.
    """
    found = decontaminate.contamination(whole(docs, "text"), table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.is_contaminated()).select("whole.*")


@owned
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with `copies`, how often; sources come near their target weights.

    Null and empty texts have no words, long ones count whole; rows of one id are documents of their own. Rows alike in all
    columns but maps are one text here with their number, and leave as the rows that are taken. An empty table stays empty.
    """
    taken = settled(spark, lambda: mixing.mixed(docs).where("copies > 0").groupBy("variant", "copies").agg(F.count("*").alias("n")), kept=True)
    # one shuffle of the texts, by variant, after equal rows of a task have become one
    texts = mixing.sized(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")).groupBy("variant").agg(F.first("whole").alias("whole"))
    found = mixing.repeated(texts.join(taken.hint("merge"), "variant"), "n", taken.agg(F.max("n")).first()[0] or 0)
    return found.select(*[F.col(f"whole.`{c}`").alias(c) for c in docs.columns if c != "copies"], "copies")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mix_stage),
]

#: A learned classifier and a random rounding are no SQL; tests hold each stage against a plain version of it.
ORACLE_SQL = None


@owned
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the table documents."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(spark, lambda of=docs, stage=stage: stage(spark, of, sf_dir), kept=i == len(STAGES) - 2)
        if i:
            removed(before)
    return STAGES[-1][1](spark, docs, sf_dir)
