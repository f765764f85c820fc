"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from tidemark.llm import chat, decontaminate, html_text, packing, sharding, simhash, substrings, toxicity, urls, vectors

QUERIES = {
    "op1_packing": packing.query,
    "op2_substring_dedup": substrings.query,
    "op3_html_extraction": html_text.query,
    "op4_toxicity": toxicity.query,
    "op5_embedding_dedup": vectors.query,
    "op6_url_filter": urls.query,
    "op7_decontamination": decontaminate.query,
    "op8_simhash": simhash.query,
    "op9_chat_format": chat.query,
    "op10_sharding": sharding.query,
}

#: The others are not expressible in SQL (tokenizer, XXH64, CRC-32, trained models, alignment, HTML
#: parsing) and are tested against brute force, round trips or held-out labels.
ORACLE_SQL = {
    "op2_substring_dedup": substrings.ORACLE_SQL,
    "op5_embedding_dedup": vectors.ORACLE_SQL,
    "op9_chat_format": chat.ORACLE_SQL,
}
