"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat, fingerprint, htmltext, images, jaccard, mixing, packing, quality, repair, secrets, sharding, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard_join": jaccard.op1_ngram_jaccard_join,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_document_fingerprints": fingerprint.op3_document_fingerprints,
        "op4_quality_classifier": quality.op4_quality_classifier,
        "op5_html_extraction": htmltext.op5_html_extraction,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_chat_formatting": chat.op8_chat_formatting,
        "op9_media_copies": images.op9_media_copies,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
        "op12_conversation_repair": repair.op12_conversation_repair,
        "op13_sharding": sharding.op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": jaccard.ORACLE,
        "op7_secret_scan": secrets.oracle(),
        "op10_mix_sources": mixing.ORACLE,
        "op12_conversation_repair": repair.ORACLE,
    }
