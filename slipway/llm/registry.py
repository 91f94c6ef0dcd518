"""The package's queries and their SQL, by name."""

from __future__ import annotations

from slipway.llm import (
    annsearch, chat, crf, ctw, decontaminate, linededup, maxsketch, ngramjoin, packing, quality, resharding, spelling,
    toxicity)

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_ngram_join": ngramjoin.op3_ngram_join,
    "op4_mincost_reshard": resharding.op4_mincost_reshard,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_context_tree": ctw.op7_context_tree,
    "op8_quality": quality.op8_quality,
    "op9_two_fit": packing.op9_two_fit,
    "op10_vantage_point": annsearch.op10_vantage_point,
    "op11_max_sketch": maxsketch.op11_max_sketch,
    "op12_crf_language": crf.op12_crf_language,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES = {
    "op1_chat_format": chat.OP1_SQL,
    "op5_line_dedup": linededup.OP5_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op11_max_sketch": maxsketch.OP11_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
