"""What several operators need: written tables in the shared folder, label folds, Arrow passes over texts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.bytesweep import chunks


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see; a temporary one only on a single machine that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Of each call of an operator that is under way, its written tables and whether its result reads them.
_open: ContextVar[tuple[dict, ...]] = ContextVar("open", default=())
#: Tables that results handed out read, until clear().
_handed_out: dict[str, SparkSession] = {}
#: Lets Spark delete the shuffle files of a query as soon as that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, kept: bool = False) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, its lineage cut, whole if an executor is lost.

    Within a call of an owned() function the table goes when this ends, unless it is kept: a result reads it later.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}"
    if scopes := _open.get():
        scopes[-1][path] = kept
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    made = spark.read.schema(df.schema).parquet(path)
    made.quern_path = path
    return made


def _deleted(spark: SparkSession, paths: Iterable[str]) -> None:
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def removed(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing is read from any more, before the call that made them ends."""
    for df in tables:
        _deleted(df.sparkSession, [df.quern_path])
        for scope in _open.get():
            scope.pop(df.quern_path, None)


@contextmanager
def owner(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that are written within, but for the kept ones, which pass to the owner around this; if it fails, all."""
    mine: dict[str, bool] = {}
    outer = _open.get()
    token = _open.set((*outer, mine))
    try:
        yield
    except BaseException:
        _deleted(spark, mine)
        raise
    finally:
        _open.reset(token)
    _deleted(spark, [path for path, kept in mine.items() if not kept])
    handed = [path for path, kept in mine.items() if kept]
    if outer:
        outer[-1].update(dict.fromkeys(handed, True))
    else:
        _handed_out.update(dict.fromkeys(handed, spark))


def owned(fn: Callable) -> Callable:
    """`fn`, whose first argument is a session or a DataFrame, as the owner of the tables that it writes."""

    @wraps(fn)
    def run(first: SparkSession | DataFrame, *args, **named):
        with owner(first.sparkSession if isinstance(first, DataFrame) else first):
            return fn(first, *args, **named)

    return run


def settled(spark: SparkSession, make: Callable[[], DataFrame], kept: bool = False) -> DataFrame:
    """What `make` gives, written; all other tables that it wrote on the way are deleted, those its result read too."""
    mine: dict[str, bool] = {}
    token = _open.set((*_open.get(), mine))
    try:
        found = written(make())
    except BaseException:
        _deleted(spark, mine)
        raise
    finally:
        _open.reset(token)
    mine.pop(found.quern_path)
    _deleted(spark, mine)
    if scopes := _open.get():
        scopes[-1][found.quern_path] = kept
    return found


def clear() -> None:
    """Deletes the tables that results handed out so far read. Those results can't be used any more."""
    for path, spark in list(_handed_out.items()):
        _deleted(spark, [path])
        del _handed_out[path]


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as 0, the fold that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)), F.lit(0)).cast("int")


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, fold, label) of the rows that may be learned from; one row for each id, the larger label if they differ."""
    return (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .select("doc_id", fold().alias("fold"), "label")
        .where("fold != 0")
    )


def apart(df: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """The needed columns of `df` and, as the struct `carried`, all others, so that no name of theirs can clash; their names."""
    rest = [c for c in df.columns if c not in needed]
    carried = F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_")) if "_" not in rest else F.struct(*[F.col(f"`{c}`") for c in rest])
    return df.select(*needed, carried.alias("carried")), rest


def together(df: DataFrame, rest: list[str], *made: str) -> DataFrame:
    """The columns that apart() put away, and those made; one that is made replaces another of its name."""
    return df.select(*[F.col(f"carried.`{c}`").alias(c) for c in rest if c not in made], *made)


def with_fields(df: DataFrame, kept: list[str], schema: str) -> T.StructType:
    """The kept columns' fields and those of the DDL `schema`."""
    return T.StructType([df.schema[c] for c in kept] + T.StructType.fromDDL(schema).fields)


def over_texts(df: DataFrame, text: str, fn: Callable[[list], dict], schema: str, limit: int = 1 << 20) -> DataFrame:
    """`df` without its text column and with the columns that `fn` makes from a bounded chunk of whole texts."""
    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(pc.binary_length(batch.column(text)).to_pylist(), limit):
                texts = batch.column(text).slice(lo, hi - lo).to_pylist()
                yield pa.RecordBatch.from_pydict({c: batch.column(c).slice(lo, hi - lo) for c in kept} | fn(texts))

    return df.select(*kept, text).mapInArrow(run, with_fields(df, kept, schema))


def ready(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package when the session was started from elsewhere.

    On a cluster the package is installed or sent along with --py-files, as usual.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    there = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in there.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = root + (os.pathsep + there if there else "")
