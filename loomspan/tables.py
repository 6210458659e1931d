"""Readers of the store's tables.

Only known columns are selected, so that extra columns of any name in a file
never reach an operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of each table, in file order.
COLUMNS: dict[str, list[str]] = {
    "drawers": ["id", "content", "wing", "room", "hall", "source_file", "chunk_index", "added_by", "filed_at", "filed_at_ts", "normalize_version", "entities"],
    "entities": ["id", "name", "type", "properties", "created_at"],
    "triples": ["id", "subject", "predicate", "object", "valid_from", "valid_to", "confidence", "source_closet", "source_file", "source_drawer_id", "adapter_name", "extracted_at"],
    "diary_entries": ["id", "wing", "agent", "date", "filed_at", "topic", "content"],
    "messages": ["uuid", "parent_uuid", "session_id", "type", "role", "content", "timestamp", "source_file"],
    "chat_messages": ["conversation_uuid", "message_uuid", "position", "sender", "text", "created_at"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars", "wing", "room", "filed_at"],
    "deletions": ["record_table", "record_id", "deleted_at"],
    "doc_labels": ["doc_id", "label"],
    "eval_items": ["item_id", "suite", "split", "text"],
    "adapters": ["adapter_name", "home_zone", "date_order"],
    "agents": ["agent", "home_zone", "date_order"],
    "given_names": ["given_name"],
    "embeddings": ["vec_id", "embedding", "label"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`, restricted to its known columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    known = COLUMNS.get(name)
    return df.select(*known) if known else df
