"""The registered queries of this subpackage."""

from __future__ import annotations

from lumivox.llm import conversations, decontaminate, line_dedup, manifest, near_dedup, neighbours, ngram_join, pieces, quality, sharding, substring_dedup, token_files

QUERIES = {
    f.__name__: f
    for f in (
        substring_dedup.op1_substring_dedup,
        quality.op2_quality,
        pieces.op3_token_counts,
        sharding.op4_jump_shards,
        neighbours.op5_projected_neighbours,
        line_dedup.op6_line_dedup,
        token_files.op7_orc_tokens,
        decontaminate.op8_decontamination,
        pieces.op9_sentencepiece,
        near_dedup.op10_simhash_near_dedup,
        conversations.op11_conversation_repair,
        manifest.op12_merkle_manifest,
        ngram_join.op13_ngram_join,
    )
}
#: Where SQL can't express a query, tests/llm hold it against brute force, its library or held-out labels.
ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op11_conversation_repair": conversations.ORACLE_SQL,
    "op12_merkle_manifest": manifest.ORACLE_SQL,
    "op13_ngram_join": ngram_join.ORACLE_SQL,
}
