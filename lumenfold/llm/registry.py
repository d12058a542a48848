"""Queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, oracles, topk, warc
from .decontaminate import op9_decontamination
from .language_id import op5_language_id
from .licenses import op8_license_scan
from .near_dedup import op7_near_dedup
from .packing import op10_packing
from .secret_scan import op4_secret_scan
from .token_counts import op3_token_counts
from .topk import op6_exact_topk
from .toxicity import op1_toxicity
from .warc import op2_warc_index


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_warc_index, op3_token_counts, op4_secret_scan, op5_language_id, op6_exact_topk, op7_near_dedup, op8_license_scan, op9_decontamination, op10_packing)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_index": warc.ORACLE,
        "op4_secret_scan": oracles.SECRET_SCAN,
        "op6_exact_topk": topk.ORACLE,
        "op7_near_dedup": oracles.NEAR_DEDUP,
        "op8_license_scan": licenses.oracle(),
        "op9_decontamination": oracles.DECONTAMINATION,
    }
