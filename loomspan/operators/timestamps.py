"""Problem 7: mixed time spellings and zones to one UTC form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.timestamps import AGAINST, readings, utc_text
from loomspan.operators.chain import resolve
from loomspan.tables import load


def _values(records: DataFrame, table: str, key: str, fields: dict[str, bool], sources: DataFrame, source_key: str, fallback: str, order: str) -> DataFrame:
    """A row for each value: the records' further columns, record_table, record_id, field_name, value, source, at, home_zone, date_order, end_of_day."""
    # one row for each adapter or agent, a table of fixed size; Spark itself decides on broadcasting it
    homes = sources.groupBy(F.trim(source_key).alias("home_key")).agg(F.min("home_zone").alias("home_zone"), F.min("date_order").alias("date_order"))
    further = [c for c in records.columns if c not in (key, *fields, source_key, fallback, order)]
    own = records.select(*further, F.col(key).alias("record_id"), F.trim(source_key).alias("source_name"), F.col(fallback).alias("other"), F.col(order).cast("string").alias("at"), *fields)
    joined = own.join(homes, own.source_name == homes.home_key, "left")
    each = [F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value"), F.lit(end).alias("end_of_day")) for f, end in fields.items()]
    return joined.select(*further, "record_id", F.concat_ws("/", F.lit(table), F.coalesce("source_name", "other")).alias("source"), "at", "home_zone", "date_order", F.explode(F.array(*each)).alias("f")).select(
        *further, F.lit(table).alias("record_table"), "record_id", "f.field_name", "f.value", F.concat_ws("/", "source", "f.field_name").alias("source"), "at", "home_zone", "date_order", "f.end_of_day"
    )


def normalise(values: DataFrame, rows: int | None = None) -> DataFrame:
    """Choose one reading of each value of triple_values or diary_values: record_table, record_id, field_name, value, further columns, utc.

    All values pass the Viterbi chain of `operators.chain`, in their source's
    record order; a declared date order and the other rules are the readings'
    own costs, high enough that the chain decides only what the rules leave
    open. A value that can only be read against a rule is impossible. Values
    without a reading have no row. rows: a bound on the number of values.
    """
    read = readings(F.col("value"), F.col("home_zone"), F.col("date_order"), F.col("end_of_day"))
    known = values.filter(F.col("value").rlike(r"\S"))
    return resolve(known, rows, read).filter(F.col("prior") < AGAINST).drop("spelling", "prior", "home_zone", "date_order", "end_of_day")


def triple_values(spark: SparkSession, sf_dir: str, triples: DataFrame | None = None, further: tuple[str, ...] = ()) -> DataFrame:
    t = (load(spark, sf_dir, "triples") if triples is None else triples).select("id", "valid_from", "valid_to", "adapter_name", "source_file", "extracted_at", *further)
    return _values(t, "triples", "id", {"valid_from": False, "valid_to": True}, load(spark, sf_dir, "adapters"), "adapter_name", "source_file", "extracted_at")


def diary_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "diary_entries").select("id", "filed_at", "agent", "wing", "date")
    return _values(d, "diary_entries", "id", {"filed_at": False}, load(spark, sf_dir, "agents"), "agent", "wing", "date")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_table, record_id, field_name, utc) of every readable time.

    Null, blank, impossible and vague values are not listed; repeated rows are
    listed once; an empty table gives no rows.
    """
    values = triple_values(spark, sf_dir).unionByName(diary_values(spark, sf_dir))
    rows = 2 * load(spark, sf_dir, "triples").count() + load(spark, sf_dir, "diary_entries").count()  # from the files' footers
    return normalise(values, rows).select("record_table", "record_id", "field_name", utc_text(F.col("utc")).alias("utc")).dropDuplicates()
