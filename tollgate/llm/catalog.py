"""The registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from tollgate.llm import (ann, bpe_queue, chat, exact_dedup, importance, lexical, line_dedup, ngram_join, packing, pieces, quality, secrets,
                          toxicity)

QUERIES = {
    "op1_quality": quality.query,
    "op2_chat_format": chat.query,
    "op3_best_fit_packing": packing.query,
    "op4_nearest": ann.query,
    "op5_secret_scan": secrets.query,
    "op6_toxicity": toxicity.query,
    "op7_sentencepiece": pieces.query,
    "op8_ngram_join": ngram_join.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_line_dedup": line_dedup.query,
    "op11_importance_resampling": importance.query,
    "op12_lexical_search": lexical.query,
    "op13_byte_bpe": bpe_queue.query,
}

ORACLE = {
    "op2_chat_format": chat.SQL,
    "op8_ngram_join": ngram_join.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op12_lexical_search": lexical.SQL,
}
