"""Fill-in-middle transformation with a two-pass streaming matcher.

A text is cut at two boundaries between its units, lines unless a pattern says otherwise. Which boundaries depends on the
number of units, and each pass over the text is a lazy iterator of matches: the first one counts the units, the second one
advances to the lower and then to the higher rank and keeps the two offsets. No list of units or of their places is made, so
that beside the text and the result a text of any length takes the same memory.

The draws come from a hash of the id alone, so that a rerun, or another partitioning, gives the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bytesweep import chunks
from quern.llm.shared import apart, together, with_fields
from quern.sources.tables import table

LINES = r"[^\n]*\n|[^\n]+"
SEED = 7
#: Of 100 texts, how many are transformed, and of these how many have the suffix first.
RATE, SUFFIX_FIRST = 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of `seed:id`; a null id counts as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def boundaries(unit: re.Pattern, text: str, one: int, other: int) -> tuple[int, int, int]:
    """The number of units, and the offsets behind the first one % (n + 1) and other % (n + 1) of them, the smaller first."""
    n = sum(1 for _ in unit.finditer(text))
    low, high = sorted((one % (n + 1), other % (n + 1)))
    matches = unit.finditer(text)
    begin = next(islice(matches, low - 1, low)).end() if low else 0
    end = next(islice(matches, high - low - 1, high - low)).end() if high > low else begin
    return n, begin, end


def fill_in_middle(docs: DataFrame, unit: str = LINES, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """`docs` without its text and with n (units), form, prefix_chars, middle_chars (code points) and output.

    docs: doc_id, text and any other columns; those of the names made are replaced. unit: a pattern, matched from left to
    right; what lies between matches belongs to the part of the next one. A text stays as it is, with the form plain and
    null lengths, if it is empty or null, holds one of the markers, or is drawn to by `rate`. Else `suffix_first` of 100 have
    the form spm, suffix, prefix, middle, and the rest psm. Texts are taken whole, however long. Equal draws cut off an
    empty middle; rows that repeat come out alike, a null id like others. An empty table stays empty.
    """
    found, rest = apart(docs, "doc_id", "text")
    one, other, transform, order = draws(F.col("doc_id"), seed)
    text = F.coalesce("text", F.lit(""))
    plain = (text == "") | (F.pmod(transform, F.lit(100)) >= rate)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | text.contains(marker)
    form = F.when(plain, "plain").when(F.pmod(order, F.lit(100)) < suffix_first, "spm").otherwise("psm")
    found = found.select("doc_id", "carried", one.alias("one"), other.alias("other"), form.alias("form"), text.alias("text"))
    kept = ["doc_id", "carried", "form"]

    def made(text: str, one: int, other: int, form: str, pattern: re.Pattern) -> tuple:
        n, begin, end = boundaries(pattern, text, one, other)
        if form == "plain":
            return n, None, None, text
        prefix, middle, suffix = text[:begin], text[begin:end], text[end:]
        head = (PREFIX, prefix, SUFFIX, suffix) if form == "psm" else (SUFFIX, suffix, PREFIX, prefix)
        return n, begin, end - begin, "".join((*head, MIDDLE, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        for batch in batches:
            for lo, hi in chunks(pc.binary_length(batch.column("text")).to_pylist()):
                part = batch.slice(lo, hi - lo)
                rows = [made(*row, pattern) for row in zip(*(part.column(c).to_pylist() for c in ("text", "one", "other", "form")), strict=True)]
                kinds = {"n": pa.int64(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
                out = {c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(kinds.items())}
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in kept} | out)

    found = found.mapInArrow(run, with_fields(found, kept, "n long, prefix_chars long, middle_chars long, output string"))
    return together(found, rest, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed one was made of.

    No part of it holds a marker, and no end of a marker is the beginning of one, so markers are found where they were put.
    """
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    inner = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    place = F.instr(head, inner)  # code points
    first, second = F.substring(head, F.lit(len(PREFIX) + 1), place - len(PREFIX) - 1), F.substring(head, place + len(SUFFIX), F.length(head))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 13."""
    found = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


def _draw(i: int) -> str:
    return f"CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * i + 1}, 8) AS BIGINT)"


ORACLE_SQL = f"""
    WITH units AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
            {", ".join(f"{_draw(i)} AS h{i + 1}" for i in range(4))}
        FROM documents),
    ranks AS (
        SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
            CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
                WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
        FROM units),
    parts AS (
        SELECT *, coalesce(array_to_string(u[1:lo], ''), '') AS p, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(u[hi + 1:], ''), '') AS s
        FROM ranks)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
            ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
        sha256(text) AS restored_sha256
    FROM parts"""
