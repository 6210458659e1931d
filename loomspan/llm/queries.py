"""Queries of the problems tagged llm, and their SQL where there is one."""

from loomspan.llm import chunking, contamination, conversations, neardup, pii, quality, tokenizer

QUERIES = {
    "p1_found": chunking.p1_found,
    "p1_pieces": chunking.p1_pieces,
    "p1_checked": chunking.p1_checked,
    "p3_found": pii.p3_found,
    "p3_redacted": pii.p3_redacted,
    "p4_found": conversations.p4_found,
    "p4_conversations": conversations.p4_conversations,
    "p6_found": neardup.p6_found,
    "p6_groups": neardup.p6_groups,
    "p8_ids": tokenizer.p8_ids,
    "p8_lengths": tokenizer.p8_lengths,
    "p9_found": contamination.p9_found,
    "p9_near": contamination.p9_near,
    "p10_found": quality.p10_found,
    "p10_kinds": quality.p10_kinds,
    "p10_stats": quality.p10_stats,
}
ORACLES = {
    "p1_found": chunking.P1_FOUND_SQL,
    "p1_checked": chunking.P1_CHECKED_SQL,
    "p4_found": conversations.P4_FOUND_SQL,
    "p4_conversations": conversations.P4_CONVERSATIONS_SQL,
    "p6_found": neardup.P6_FOUND_SQL,
    "p9_found": contamination.P9_FOUND_SQL,
    "p10_stats": quality.P10_STATS_SQL,
}
