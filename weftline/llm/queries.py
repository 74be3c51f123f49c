"""The registered queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.codebooks import op13_codebooks
from weftline.llm.decontamination import op5_decontamination
from weftline.llm.fingerprints import op1_fingerprints
from weftline.llm.licenses import op6_licenses
from weftline.llm.mixing import OP7_SQL, op7_mixing
from weftline.llm.phrases import OP11_SQL, op11_phrases
from weftline.llm.pitmanyor import op10_pitmanyor
from weftline.llm.secrets import op12_secrets
from weftline.llm.simhash import op3_simhash
from weftline.llm.suffixes import op2_suffixes
from weftline.llm.tokencount import op4_tokencount
from weftline.llm.toxicity import op9_toxicity
from weftline.llm.warc import OP8_SQL, op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_suffixes, op3_simhash, op4_tokencount, op5_decontamination, op6_licenses, op7_mixing, op8_warc, op9_toxicity, op10_pitmanyor, op11_phrases, op12_secrets, op13_codebooks)}


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": OP7_SQL, "op8_warc": OP8_SQL, "op11_phrases": OP11_SQL}
