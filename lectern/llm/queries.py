"""The registered queries of this subpackage and their DuckDB forms."""

from __future__ import annotations

from . import conversation_repair, language_id, media, mixing, personal_data, prefix_trie, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, sharding, simhash, url_filter

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_media": media.op2_media,
    "op3_sentencepiece": sentencepiece_codec.op3_sentencepiece,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_personal_data": personal_data.op5_personal_data,
    "op6_mixing": mixing.op6_mixing,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_simhash": simhash.op8_simhash,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_language_id": language_id.op13_language_id,
}

ORACLE = {
    "op1_sharding": sharding.OP1_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
}
