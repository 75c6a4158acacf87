"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat
from .chat import op2_chat_format
from .decontam import op7_decontaminate
from .grid_join import op3_grid_join
from .licenses import op6_license_scan
from .ngram import op8_ngram_scores
from .pieces import op5_sentencepiece
from .pii import op1_pii
from .quality import op4_quality
from .secrets import op10_secret_scan
from .simhash import op9_simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_chat_format, op3_grid_join, op4_quality, op5_sentencepiece, op6_license_scan, op7_decontaminate, op8_ngram_scores, op9_simhash, op10_secret_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat.oracle()}
