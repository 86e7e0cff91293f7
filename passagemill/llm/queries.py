"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, classify, decontaminate, lines, lm, merkle, near, packing, quality, ranked, secrets, sstable, urls

QUERIES = {
    "op1_lm_scoring": lm.op1_lm_scoring,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_jaccard_join": near.op4_jaccard_join,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_url_filters": urls.op6_url_filters,
    "op7_token_shards": sstable.op7_token_shards,
    "op8_packing": packing.op8_packing,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_secret_scans": secrets.op10_secret_scans,
    "op11_quality_classifier": classify.op11_quality_classifier,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_ranked_search": ranked.op13_ranked_search,
}
ORACLE_SQL = {
    "op1_lm_scoring": lm.OP1_SQL,
    "op2_chat_formatting": chat.OP2_SQL,
    "op5_benchmark_decontamination": decontaminate.OP5_SQL,
    "op6_url_filters": urls.OP6_SQL,
    "op9_line_dedup": lines.OP9_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_ranked_search": ranked.OP13_SQL,
}
