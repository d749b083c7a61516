"""Queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, credentials, licenses, lines, media, minhash, mixing, oracles, quality, repair, suffixes, tries, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (minhash.op1_minhash_dedup, licenses.op2_license_scan, chat.op5_chat_format, lines.op4_line_dedup, quality.op10_quality_rules, warc.op3_warc, suffixes.op6_suffix_dedup, media.op7_media_columns, bpe.op8_byte_bpe, mixing.op9_mix_sources, credentials.op12_secret_scan, tries.op13_prefix_trie, repair.op11_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_dedup": oracles.OP1,
        "op3_warc": oracles.OP3,
        "op4_line_dedup": lines.OP4_SQL,
        "op5_chat_format": chat.OP5_SQL,
        "op6_suffix_dedup": oracles.OP6,
        "op9_mix_sources": oracles.OP9,
        "op11_conversation_repair": oracles.OP11,
        "op13_prefix_trie": oracles.OP13,
    }
