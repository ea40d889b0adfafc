"""The subpackage's queries and the SQL that checks them."""

from __future__ import annotations

from corvane.llm import ann, chat, decontamination, language_id, near_duplicates, packing, quality, sharding, toxicity, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_sharding": sharding.op2_sharding,
    "op3_near_duplicates": near_duplicates.op3_near_duplicates,
    "op4_packing": packing.op4_packing,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_nearest_neighbours": ann.op7_nearest_neighbours,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_language_id": language_id.op9_language_id,
    "op10_quality": quality.op10_quality,
}
ORACLES = {
    "op1_url_filters": url_filters.ORACLE,
    "op5_chat_formatting": chat.ORACLE,
    "op8_decontamination": decontamination.ORACLE,
}
