"""The operators' queries, as the driver registers them."""

from __future__ import annotations

from labelweave.llm import audit, bpe, chat, decontaminate, licences, passages, quality, repeats, sharding, simhash, urls, warc, whitening


def queries() -> dict:
    return {
        "op1_url_filters": urls.query,
        "op2_license_scans": licences.query,
        "op3_simhash_near_dedup": simhash.query,
        "op4_substring_dedup": passages.query,
        "op5_benchmark_decontamination": decontaminate.query,
        "op6_warc": warc.query,
        "op7_suffix_array_dedup": repeats.query,
        "op8_quality_rules": quality.query,
        "op9_byte_bpe": bpe.query,
        "op10_sharding": sharding.query,
        "op11_filter_audit": audit.query,
        "op12_embedding_whitening": whitening.query,
        "op13_chat_formatting": chat.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": urls.oracle_sql(),
        "op4_substring_dedup": passages.oracle_sql(),
        "op5_benchmark_decontamination": decontaminate.oracle_sql(),
        "op6_warc": warc.oracle_sql(),
        "op7_suffix_array_dedup": repeats.oracle_sql(),
        "op8_quality_rules": quality.oracle_sql(),
        "op11_filter_audit": audit.oracle_sql(),
        "op13_chat_formatting": chat.oracle_sql(),
    }
