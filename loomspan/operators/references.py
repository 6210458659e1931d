"""Problem 2: references to records that do not exist.

Referred keys are coded as integers, in ranges of their order. For each key
range (32,768 codes) and month a compressed bitmap holds the keys referred to;
for each key range and month of first filing another holds the keys there are.
A range's bitmaps are read in order of time: a reference bitmap AND-NOT the
parents filed in earlier months leaves the keys to look at: those missing,
deleted, or filed in the same month or later. Only their references are
compared by exact time.

A bitmap is kept as the sorted places of its set bits while these are fewer
than 2,048, and as 4,096 bytes beyond, whichever is shorter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.intervals import entity_key
from loomspan.runtime import checkpointed, partitions
from loomspan.tables import load

#: Bits of a bitmap, and set bits up to which their places are kept instead.
BITS = 32_768
SPARSE = 2_048
#: Month of parents without a time; before every month.
ALWAYS = -1_000_000


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at) - 1


def fact_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(triple_id, ref_field, domain, key, extracted_at, month); null and blank values are no references."""
    t = load(spark, sf_dir, "triples")
    ref = lambda field, domain, key: F.struct(F.lit(field).alias("ref_field"), F.lit(domain).alias("domain"), key.alias("key"))
    each = F.array(
        ref("subject", "entities", entity_key(F.col("subject"))),
        ref("object", "entities", entity_key(F.col("object"))),
        ref("source_drawer_id", "drawers", _trimmed(F.col("source_drawer_id"))),
    )
    rows = t.select(F.col("id").alias("triple_id"), F.explode(each).alias("r"), "extracted_at", F.coalesce(_month(F.col("extracted_at")), F.lit(ALWAYS - 1)).alias("month"))
    return rows.select("triple_id", "r.ref_field", "r.domain", "r.key", "extracted_at", "month").filter("key <> ''")


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, key, created_at) of every record that is there; created_at may be null."""
    iso = F.when(F.col("filed_at").rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.col("filed_at")).otherwise(F.concat("filed_at", F.lit("Z")))
    drawers = load(spark, sf_dir, "drawers").select(F.lit("drawers").alias("domain"), _trimmed(F.col("id")).alias("key"), iso.try_cast("timestamp").alias("created_at"))
    entities = load(spark, sf_dir, "entities").select(F.lit("entities").alias("domain"), _trimmed(F.col("id")).alias("key"), "created_at")
    return drawers.unionByName(entities).filter("key <> ''")


def removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "deletions").select(F.col("record_table").alias("domain"), _trimmed(F.col("record_id")).alias("key"))


def orphans(refs: DataFrame, there: DataFrame, gone: DataFrame) -> DataFrame:
    """(triple_id, ref_field, reason, month) of the references without a target.

    `refs` as of fact_references, `there` as of parents, `gone` (domain, key).
    reason is deleted, missing or late. A reference without a time is never
    late, nor is one to a key whose records all lack a time; of several times
    of a key the earliest counts. Repeated rows give one row.
    A key of any share of the references is one bit a month: keys are combined
    before every shuffle but the last, an inner join that AQE splits on skew.
    """
    spark = refs.sparkSession
    used = refs.groupBy("domain", "key", "month").agg(F.lit(1).alias("one"))
    none = lambda kind: F.lit(None).cast(kind)
    columns = {"used": "boolean", "there": "boolean", "created_at": "timestamp", "gone": "boolean"}
    part = lambda df, **own: df.select("domain", "key", *[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
    facts = part(used, used=F.lit(True)).unionByName(part(there, there=F.lit(True), created_at=F.col("created_at"))).unionByName(part(gone, gone=F.lit(True)))
    keys = facts.groupBy("domain", "key").agg(F.max("used").alias("used"), F.max("there").alias("there"), F.min("created_at").alias("created_at"), F.max("gone").alias("gone")).filter("used")
    ranged = keys.repartitionByRange(partitions(spark), "domain", "key").sortWithinPartitions("domain", "key")
    # written once: the codes must not change between the reads below
    dictionary = checkpointed(ranged.select("*", (F.monotonically_increasing_id() + 1).alias("code")))

    # parents come before the references of a month that is theirs or later
    since = F.coalesce(_month(F.col("created_at")) + 1, F.lit(ALWAYS))
    filed = dictionary.filter("there").select("code", since.alias("month"), F.lit(0).alias("kind"))
    referred = used.join(dictionary.select("domain", "key", "code"), ["domain", "key"]).select("code", "month", F.lit(1).alias("kind"))
    left = survivors(bitmaps(filed.unionByName(referred)))
    looked = left.join(dictionary, "code").select("domain", "key", "month", "there", "created_at", "gone")
    reason = F.when(F.col("there").isNull(), F.when(F.col("gone"), "deleted").otherwise("missing")).when(F.col("created_at") > F.col("extracted_at"), "late")
    return refs.join(looked, ["domain", "key", "month"]).select("triple_id", "ref_field", reason.alias("reason"), "month").filter("reason is not null").dropDuplicates()


def packed(places: np.ndarray) -> bytes:
    """A compressed bitmap of sorted distinct places."""
    if len(places) < SPARSE:
        return places.astype("<u2").tobytes()
    bits = np.zeros(BITS, np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpacked(bitmap: bytes) -> np.ndarray:
    """A boolean for each bit."""
    if len(bitmap) == BITS // 8:
        return np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").astype(bool)
    out = np.zeros(BITS, bool)
    out[np.frombuffer(bitmap, "<u2")] = True
    return out


def bitmaps(codes: DataFrame) -> DataFrame:
    """(bucket, month, kind, bits) of the rows (code, month, kind): a bitmap for each key range, month and kind of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            code = pdf["code"].to_numpy(np.int64)
            rows = np.unique(np.column_stack([code // BITS, pdf["month"], pdf["kind"], code % BITS]), axis=0)
            first = np.flatnonzero(np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)])) if len(rows) else np.zeros(0, np.int64)
            bits = [packed(p) for p in np.split(rows[:, 3], first[1:])] if len(rows) else []
            yield pd.DataFrame({"bucket": rows[first, 0], "month": rows[first, 1], "kind": rows[first, 2], "bits": bits})

    return codes.mapInPandas(run, "bucket long, month int, kind int, bits binary")


def survivors(maps: DataFrame) -> DataFrame:
    """(code, month): the codes referred to in a month whose parents aren't among those of earlier months.

    A range's bitmaps are read once, in order of time, beside the union of the parents so far.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, parents = None, np.zeros(BITS, bool)
        for pdf in batches:
            codes, months = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for b, month, kind, bits in zip(pdf["bucket"].tolist(), pdf["month"].tolist(), pdf["kind"].tolist(), pdf["bits"]):
                if b != bucket:
                    bucket, parents = b, np.zeros(BITS, bool)
                own = unpacked(bits)
                if kind == 0:
                    parents |= own
                else:
                    at = np.flatnonzero(own & ~parents)
                    codes.append(b * BITS + at)
                    months.append(np.full(len(at), month))
            yield pd.DataFrame({"code": np.concatenate(codes), "month": np.concatenate(months)})

    ordered = maps.repartition("bucket").sortWithinPartitions("bucket", "month", "kind")
    return ordered.mapInPandas(run, "code long, month int").dropDuplicates()


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(fact_references(spark, sf_dir), parents(spark, sf_dir), removed(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(triple_id, ref_field, reason) of every orphan reference."""
    return _found(spark, sf_dir).select("triple_id", "ref_field", "reason").dropDuplicates()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_field, month, reason, n): orphans per field and month of extracted_at; month as YYYY-MM, null without a time."""
    month = F.when(F.col("month") >= 0, F.concat(F.lpad(F.floor(F.col("month") / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.col("month") % 12 + 1).cast("string"), 2, "0")))
    return _found(spark, sf_dir).groupBy("ref_field", month.alias("month"), "reason").agg(F.count("*").alias("n"))


_ORPHANS_SQL = """
WITH refs AS (
  SELECT DISTINCT id AS triple_id, f AS ref_field, extracted_at,
         CASE WHEN f = 'source_drawer_id' THEN 'drawers' ELSE 'entities' END AS domain,
         CASE f WHEN 'subject' THEN translate(lower(regexp_replace(subject, '^\\s+|\\s+$', '', 'g')), ' ''’', '_')
                WHEN 'object' THEN translate(lower(regexp_replace(object, '^\\s+|\\s+$', '', 'g')), ' ''’', '_')
                ELSE regexp_replace(source_drawer_id, '^\\s+|\\s+$', '', 'g') END AS key
  FROM triples CROSS JOIN (VALUES ('subject'), ('object'), ('source_drawer_id')) v(f)
), parents AS (
  SELECT domain, key, min(created_at) AS created_at FROM (
    SELECT 'entities' AS domain, trim(id) AS key, created_at FROM entities
    UNION ALL SELECT 'drawers', trim(id), TRY_CAST(filed_at AS TIMESTAMPTZ) FROM drawers)
  GROUP BY domain, key
), gone AS (SELECT DISTINCT record_table AS domain, trim(record_id) AS key FROM deletions),
found AS (
  SELECT DISTINCT triple_id, ref_field, extracted_at,
         CASE WHEN p.key IS NULL AND g.key IS NOT NULL THEN 'deleted' WHEN p.key IS NULL THEN 'missing'
              WHEN p.created_at > extracted_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN parents p ON p.domain = r.domain AND p.key = r.key
  LEFT JOIN gone g ON g.domain = r.domain AND g.key = r.key
  WHERE r.key <> '')
"""
P2_FOUND_SQL = _ORPHANS_SQL + "SELECT DISTINCT triple_id, ref_field, reason FROM found WHERE reason IS NOT NULL"
P2_REPORT_SQL = (
    _ORPHANS_SQL
    + """SELECT ref_field, strftime(timezone('UTC', extracted_at), '%Y-%m') AS month, reason, count(*) AS n
FROM (SELECT DISTINCT triple_id, ref_field, reason, extracted_at FROM found WHERE reason IS NOT NULL)
GROUP BY 1, 2, 3"""
)
