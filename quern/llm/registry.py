"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bytepairs, decontaminate, fillmiddle, htmltext, linededup, mixing, neardup, quality, tokencount, topk, toxicity, urlfilter, vectorcode
from quern.llm.shared import ready


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ready(spark)
        return fn(spark, sf_dir)

    return run


QUERIES = {
    fn.__name__: _query(fn)
    for fn in (
        topk.op1_topk,
        tokencount.op2_token_counts,
        toxicity.op3_toxicity,
        decontaminate.op4_decontaminate,
        htmltext.op5_html_text,
        mixing.op6_mix,
        linededup.op7_line_dedup,
        quality.op8_quality,
        neardup.op9_near_duplicates,
        urlfilter.op10_url_filter,
        vectorcode.op11_vector_codes,
        bytepairs.op12_bpe_round_trip,
        fillmiddle.op13_fill_in_middle,
    )
}

ORACLE_SQL = {
    "op1_topk": topk.ORACLE_SQL,
    "op4_decontaminate": decontaminate.ORACLE_SQL,
    "op7_line_dedup": linededup.ORACLE_SQL,
    "op9_near_duplicates": neardup.ORACLE_SQL,
    "op10_url_filter": urlfilter.ORACLE_SQL,
    "op11_vector_codes": vectorcode.ORACLE_SQL,
    "op13_fill_in_middle": fillmiddle.ORACLE_SQL,
}
