"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, jaccard, lines, media, packing, quality, rans, secrets, spherical


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": rans.op1,
        "op2_embedding_near_dedup": spherical.op2,
        "op3_byte_bpe": bpe.op3,
        "op4_image_copies": media.op4,
        "op5_secret_scan": secrets.op5,
        "op6_best_fit_packing": packing.op6,
        "op7_ngram_jaccard_join": jaccard.op7,
        "op8_quality_classifier": quality.op8,
        "op9_chat_formatting": chat.op9,
        "op10_line_dedup": lines.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_chat_formatting": chat.OP9_SQL,
        "op10_line_dedup": lines.OP10_SQL,
    }
