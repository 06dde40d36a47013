"""The queries of this folder and their SQL."""

from leafmill.llm import byte_bpe, chat, hard_negatives, mixture, near_dups, neighbours, passages, pieces, quality, secrets, shards, spelling, token_counts

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_mixing": mixture.op2_mixing,
    "op3_repeated_passages": passages.op3_repeated_passages,
    "op4_nearest_neighbours": neighbours.op4_nearest_neighbours,
    "op5_near_duplicates": near_dups.op5_near_duplicates,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_sharding": shards.op9_sharding,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}
ORACLES = {
    "op1_quality_rules": quality.OP1_SQL,
    "op7_chat_formatting": chat.OP7_SQL,
}
