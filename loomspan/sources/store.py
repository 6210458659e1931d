"""Stores: a plug-in source contract, exports, key-value pivots and the audit log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

RECORD = "id string, content string, source_file string, chunk_index int, wing string, room string"


class _Item(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


class RecordSource(DataSource):
    """Base of plug-in sources: `items` lists a source's parts, `records` reads one as tuples of RECORD.

    Register a subclass with `register`, then read it as any format.
    """

    @classmethod
    def name(cls) -> str:
        raise NotImplementedError

    def schema(self) -> str:
        return RECORD

    def items(self) -> list[str]:
        raise NotImplementedError

    def records(self, item: str) -> Iterator[tuple]:
        raise NotImplementedError

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self)


class _Reader(DataSourceReader):
    def __init__(self, source: RecordSource):
        self.source = source

    def partitions(self) -> list[_Item]:
        return [_Item(i) for i in self.source.items()]

    def read(self, partition: _Item) -> Iterator[tuple]:
        yield from self.source.records(partition.value)


_registered: dict[str, type[RecordSource]] = {}


def register(spark: SparkSession, source: type[RecordSource]) -> None:
    spark.dataSource.register(source)
    _registered[source.name()] = source


def resolve(explicit: str | None = None, configured: str | None = None, detect: Callable[[], str | None] | None = None, default: str = "parquet") -> str:
    """The first of explicit, configured, detected and default source that there is; unknown ones raise."""
    name = explicit or configured or (detect() if detect else None) or default
    if name not in _registered and name not in ("parquet", "json", "text", "binaryFile", "orc", "csv"):
        raise ValueError(f"no source {name!r}; known: {sorted(_registered)}")
    return name


def pivoted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a record from (id, key, string_value, int_value, float_value, bool_value): the first typed value that isn't null.

    `keys` become columns; all other keys stay in the map `extra`.
    """
    value = F.coalesce("string_value", F.col("int_value").cast("string"), F.col("float_value").cast("string"), F.col("bool_value").cast("string"))
    own = rows.select("id", "key", value.alias("value"))
    wide = [F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys]
    rest = F.map_from_entries(F.array_sort(F.collect_set(F.when(~F.col("key").isin(keys) & F.col("value").isNotNull(), F.struct("key", "value")))))
    return own.groupBy("id").agg(*wide, rest.alias("extra"))


def export(records: DataFrame, folder: str) -> None:
    """One set of Markdown files for each wing and room, and an index of their counts.

    Rows are written as sorted lines, in as many files as a place needs.
    """
    place = [F.coalesce("wing", F.lit("unknown")).alias("wing"), F.coalesce("room", F.lit("general")).alias("room")]
    title = F.concat(F.lit("## "), "id", F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    rows = records.select(*place, "id", title.alias("value"))
    rows.repartition("wing", "room", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("wing", "room", "id").select("wing", "room", "value").write.mode("overwrite").partitionBy("wing", "room").text(f"{folder}/rooms")
    rows.groupBy("wing", "room").agg(F.count("*").alias("n")).coalesce(1).orderBy("wing", "room").select(F.format_string("| %s | %s | %d |", "wing", "room", "n").alias("value")).write.mode("overwrite").text(f"{folder}/index")


#: Parameters whose values the audit log never holds.
SECRET = ("content", "entry", "text", "query", "document", "label")


def log(spark: SparkSession, folder: str, operation: str, params: dict, result: str) -> None:
    """Appends one operation; texts are replaced by their lengths."""
    kept = {k: f"<{len(str(v))} characters>" if k in SECRET else str(v) for k, v in params.items()}
    row = spark.createDataFrame([(operation, kept, result)], "operation string, params map<string,string>, result string")
    row.withColumn("at", F.current_timestamp()).write.mode("append").json(folder)
