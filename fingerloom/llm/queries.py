"""The queries of the ten operators and, where SQL can say the same, their DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fingerloom.llm.bpe import op2_bpe
from fingerloom.llm import warc
from fingerloom.llm.decontaminate import op1_decontaminate
from fingerloom.llm.langid import op9_langid
from fingerloom.llm.quality import op10_quality
from fingerloom.llm.repeats import op7_repeats
from fingerloom.llm.rules import op5_rules
from fingerloom.llm.secrets import op6_secrets
from fingerloom.llm.simhash import op4_simhash
from fingerloom.llm.urls import op3_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_bpe": op2_bpe,
    "op3_urls": op3_urls,
    "op4_simhash": op4_simhash,
    "op5_rules": op5_rules,
    "op6_secrets": op6_secrets,
    "op7_repeats": op7_repeats,
    "op8_warc": warc.op8_warc,
    "op9_langid": op9_langid,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {
    "op8_warc": warc.ORACLE,
}
