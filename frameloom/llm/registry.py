"""Queries of the training-data operators and, where SQL can express them, their DuckDB counterparts."""

from frameloom.llm import op1_simhash, op2_substring, op3_language, op4_mixing, op5_chat, op6_decontaminate, op7_media, op8_suffix_index, op9_html, op10_tokens

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash.op1_simhash_near_dedup,
    "op2_substring_dedup": op2_substring.op2_substring_dedup,
    "op3_language_id": op3_language.op3_language_id,
    "op4_mixing": op4_mixing.op4_mixing,
    "op5_chat_format": op5_chat.op5_chat_format,
    "op6_decontaminate": op6_decontaminate.op6_decontaminate,
    "op7_media_columns": op7_media.op7_media_columns,
    "op8_suffix_dedup": op8_suffix_index.op8_suffix_dedup,
    "op9_html_text": op9_html.op9_html_text,
    "op10_token_output": op10_tokens.op10_token_output,
}

ORACLES = {
    "op2_substring_dedup": op2_substring.ORACLE,
    "op4_mixing": op4_mixing.ORACLE,
    "op5_chat_format": op5_chat.ORACLE,
    "op6_decontaminate": op6_decontaminate.ORACLE,
}
