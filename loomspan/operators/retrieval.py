"""Vector, lexical and hybrid retrieval.

Queries are a set of (query_id, vector, text). Vectors are compared in blocks
of queries of a fixed size against all records, each partition keeping its own
best, so records are neither shuffled nor paired with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions.text import tokens
from loomspan.runtime import checkpointed

#: Queries of one block.
BLOCK = 2048


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def _blocks(queries: DataFrame, vector: str, block: int) -> Iterator[tuple[list, np.ndarray]]:
    ids: list = []
    rows: list = []
    for r in queries.select("query_id", F.col(vector).cast("array<double>").alias("v")).filter("v is not null").orderBy("query_id").toLocalIterator():
        ids.append(r.query_id)
        rows.append(r.v)
        if len(ids) == block:
            yield ids, np.array(rows)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows)


def nearest(records: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, key, distance, rank): the k records nearest each query by cosine distance, exactly.

    Ties go to the lesser key; the query's own record counts like any other.
    Null vectors are left out; a zero vector has distance 1 to all. Vectors of
    another length than the queries' raise. Filter the records first.
    """
    spark = records.sparkSession
    kind = dict(records.dtypes)[key]
    query_kind = dict(queries.dtypes)["query_id"]
    out = None
    own = records.select(key, F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    schema = f"query_id {query_kind}, `{key}` {kind}, distance double"
    for ids, matrix in _blocks(queries, vector, block):
        shared = spark.sparkContext.broadcast((ids, _unit(matrix)))  # a block of fixed size

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            best: pd.DataFrame | None = None
            for pdf in batches:
                if not len(pdf):
                    continue
                near = 1 - q @ _unit(np.array(pdf["v"].tolist())).T
                keys = pdf[key].to_numpy()
                order = np.lexsort((np.broadcast_to(keys, near.shape), near), axis=1)[:, :k] if keys.dtype != object else np.array([sorted(range(len(keys)), key=lambda j: (row[j], keys[j]))[:k] for row in near])
                rows = np.arange(len(names))[:, None]
                part = pd.DataFrame({"q": np.repeat(np.arange(len(names)), order.shape[1]), key: keys[order].reshape(-1), "distance": near[rows, order].reshape(-1)})
                best = part if best is None else pd.concat([best, part])
                best = best.sort_values(["q", "distance", key], kind="stable").groupby("q", sort=False).head(k)
            if best is not None:
                yield pd.DataFrame({"query_id": [names[i] for i in best["q"]], key: best[key].to_numpy(), "distance": best["distance"].to_numpy()})

        found = own.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    order = W.partitionBy("query_id").orderBy("distance", key)
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Rows that the index's centres are fitted on, and their number.
FIT_ROWS = 20_000
CENTRES = 16


def fit_centres(records: DataFrame, vector: str = "embedding", centres: int = CENTRES, rows: int = FIT_ROWS, key: str = "vec_id", rounds: int = 12) -> np.ndarray:
    """Centres of a spherical k-means on at most `rows` vectors, chosen by a hash of their keys."""
    sample = records.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), key).orderBy(F.xxhash64(key), key).limit(rows)
    m = [r.v for r in sample.collect()]
    if not m:
        return np.zeros((0, 0))
    x = _unit(np.array(m))
    c = x[np.random.default_rng(5).choice(len(x), min(centres, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = _unit(np.array([x[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))]))
    return c


def assigned(records: DataFrame, centres: np.ndarray, probes: int = 1, vector: str = "embedding") -> DataFrame:
    """`records` with the list(s) they lie in: the `probes` nearest centres as column `list`, a row for each."""
    shared = records.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def lists(v: pd.Series) -> pd.Series:
        c = shared.value
        near = -(_unit(np.array([list(x) if x is not None else [0.0] * c.shape[1] for x in v])) @ c.T)
        return pd.Series(list(np.argsort(near, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return records.filter(F.col(vector).isNotNull()).withColumn("list", F.explode(lists(F.col(vector).cast("array<double>"))))


#: Salts of a list in the index join, so that a list of any share of the rows is spread.
SALTS = 8


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return 1 - F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def nearest_by_lists(records: DataFrame, queries: DataFrame, k: int, probes: int, centres: int = CENTRES, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """As `nearest`, looking only into the lists of the `probes` nearest centres: approximate.

    Every record is in the index. Lists are joined salted; a record meets only
    the queries that probe its list, whose number doesn't grow with the records.
    """
    c = fit_centres(records, vector, centres, key=key)
    if not len(c):
        return nearest(records, queries, k, key, vector)
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")
    left = assigned(records, c, 1, vector).select(key, F.col(vector).alias("v"), "list", salt.alias("salt"))
    right = assigned(queries, c, probes, vector).select("query_id", F.col(vector).alias("q"), "list", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = left.join(right, ["list", "salt"]).select("query_id", key, cosine_distance(F.col("q"), F.col("v")).alias("distance"))
    order = W.partitionBy("query_id").orderBy("distance", key)
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Least and most bits of a sign code, rows that a code of one group holds in the mean, and the share of pairs at the threshold that share no code.
SIGN_BITS = (8, 20)
SIGN_ROWS, SIGN_MISS = 64, 0.002


def sign_codes(rows: int, threshold: float) -> tuple[int, int]:
    """(bits of a code, codes a record): more bits, the more rows the largest group has, and as many codes as the threshold then needs."""
    bits = min(max(SIGN_BITS[0], int(np.ceil(np.log2(max(rows, 1) / SIGN_ROWS)))), SIGN_BITS[1])
    same = (1 - np.arccos(max(-1.0, 1 - threshold)) / np.pi) ** bits
    return bits, int(np.ceil(np.log(SIGN_MISS) / np.log1p(-same))) if same < 1 else 1


def near_pairs(records: DataFrame, key: str, group: str, threshold: float, vector: str = "embedding") -> DataFrame:
    """(a, b, distance): records of one group nearer than `threshold`, a < b.

    Candidates share one code of the signs of random projections; each is
    verified exactly. Codes have more bits the larger the largest group is, so
    that a code holds few rows of it, and there are so many that 99.8 % of the
    pairs at the threshold share one. Null groups are no group.
    """
    own = records.filter(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(key, group, F.col(vector).cast("array<double>").alias("v"))
    largest = own.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    bits, number = sign_codes(largest, threshold)

    @F.pandas_udf("array<long>")
    def codes(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist())
        plane = np.random.default_rng(11).standard_normal((x.shape[1], number * bits)) if len(x) else np.zeros((0, 0))
        signs = (x @ plane > 0).reshape(len(x), number, bits)
        return pd.Series(list((signs @ (1 << np.arange(bits)) + (np.arange(number) << bits)).astype(np.int64)))

    coded = own.select(key, group, F.explode(codes("v")).alias("code"))
    a, b = coded.select(F.col(key).alias("a"), group, "code"), coded.select(F.col(key).alias("b"), group, "code")
    pairs = a.join(b, [group, "code"]).filter("a < b").select("a", "b").dropDuplicates()
    va, vb = own.select(F.col(key).alias("a"), F.col("v").alias("va")), own.select(F.col(key).alias("b"), F.col("v").alias("vb"))
    met = pairs.join(va, "a").join(vb, "b").select("a", "b", cosine_distance(F.col("va"), F.col("vb")).alias("distance"))
    return met.filter(F.col("distance") < threshold)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """(n, hits, recall): share of the exact neighbours that were found; null where there are none."""
    hit = exact.join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return hit.agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits")).withColumn("recall", F.round(F.try_divide("hits", "n"), 6))


def bm25(candidates: DataFrame, queries: DataFrame, key: str, text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, key, bm25) of candidates (query_id, key, text) against queries (query_id, text).

    Frequencies and mean length are of each query's own candidates; query
    words count once; a candidate without words scores 0, and is counted in
    the mean. Rows without a common word have score 0.
    """
    lengths = candidates.select("query_id", key, tokens(F.col(text)).alias("words"))
    stats = lengths.groupBy("query_id").agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    counted = lengths.select("query_id", key, F.size("words").alias("length"), F.explode("words").alias("word")).join(asked, ["query_id", "word"]).groupBy("query_id", key, "length", "word").agg(F.count("*").alias("tf"))
    df = counted.groupBy("query_id", "word").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = counted.join(df, ["query_id", "word"]).join(stats, "query_id").groupBy("query_id", key).agg(F.sum(part).alias("bm25"))
    return candidates.select("query_id", key).join(scored, ["query_id", key], "left").select("query_id", key, F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


def bm25_corpus(records: DataFrame, queries: DataFrame, key: str, text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """As bm25 where every record is a candidate of every query, without forming the pairs.

    Only records with a common word have rows. Document lengths and word
    counts are per record, statistics of the corpus are one row.
    """
    lengths = records.select(key, tokens(F.col(text)).alias("words"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    # words that a query has are kept before anything is shuffled
    wanted = asked.select("word").distinct()
    counted = lengths.select(key, F.size("words").alias("length"), F.explode("words").alias("word")).join(wanted, "word", "left_semi").groupBy(key, "length", "word").agg(F.count("*").alias("tf"))
    df = counted.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighed = asked.join(df, "word").join(F.broadcast(stats)).select("query_id", "word", idf.alias("idf"), "mean")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return counted.join(weighed, "word").groupBy("query_id", key).agg(F.sum(part).alias("bm25"))


def top(scored: DataFrame, k: int, key: str, score: str, ascending: bool = False) -> DataFrame:
    """The k best rows of each query as column rank; ties to the lesser key."""
    order = W.partitionBy("query_id").orderBy(F.asc(score) if ascending else F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hybrid(hits: DataFrame, scores: DataFrame, key: str, vector_weight: float = 0.6, lexical_weight: float = 0.4) -> DataFrame:
    """`hits` (query_id, key, distance, ...) with bm25 and fused score: 0.6 max(0, 1 - distance) + 0.4 bm25 / greatest bm25.

    A null distance has no vector part; where the greatest bm25 is 0 there is no lexical part.
    """
    joined = hits.join(scores.select("query_id", key, "bm25"), ["query_id", key], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    most = F.max("bm25").over(W.partitionBy("query_id"))
    vec = F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("distance")), F.lit(0.0))
    return joined.withColumn("most", most).withColumn("score", vector_weight * vec + lexical_weight * F.when(F.col("most") > 0, F.col("bm25") / F.col("most")).otherwise(0.0)).drop("most")


# What the first five index hits take off a record's distance, and the distance beyond which they don't.
RANK_BOOSTS = [0.40, 0.25, 0.15, 0.08, 0.04]
BOOST_CAP = 1.5


def boosted(hits: DataFrame, closets: DataFrame) -> DataFrame:
    """`hits` (query_id, source, distance) with boost and effective distance in [0, 2].

    `closets` (query_id, source, distance, rank) are index hits, rank from 1.
    A source's first hit counts. The index lifts records and never hides one.
    """
    first = closets.filter("source is not null and source <> ''").groupBy("query_id", "source").agg(F.min(F.struct("rank", "distance")).alias("c"))
    joined = hits.join(first, ["query_id", "source"], "left")
    value = F.try_element_at(F.array(*[F.lit(x) for x in RANK_BOOSTS]), F.col("c.rank"))
    boost = F.coalesce(F.when(F.col("c.distance") <= BOOST_CAP, value), F.lit(0.0))
    return joined.withColumn("boost", boost).withColumn("effective", F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col("distance") - F.col("boost")))).drop("c")


def neighbours(matched: DataFrame, records: DataFrame, radius: int = 1, text: str = "text") -> DataFrame:
    """(match_id, joined, total): texts of a record's neighbours in its source, `radius` places to each side.

    `matched` (match_id, source_file, chunk_index), `records` (source_file,
    chunk_index, text). A range join by equality on the place.
    """
    wanted = matched.select("match_id", "source_file", F.explode(F.sequence(F.col("chunk_index") - radius, F.col("chunk_index") + radius)).alias("chunk_index"))
    total = records.groupBy("source_file").agg(F.count("*").alias("total"))
    found = wanted.join(records.select("source_file", "chunk_index", text), ["source_file", "chunk_index"])
    joined = found.groupBy("match_id", "source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", text))), lambda s: s[text]), "\n\n").alias("joined"))
    return joined.join(total, "source_file", "left").select("match_id", "joined", "total")


def hydrated(boosted_hits: DataFrame, records: DataFrame, queries: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """(query_id, key, text) of boosted hits: the source's chunk with most query words, with one to each side.

    The first of equals wins; at most `most` characters are kept.
    """
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("asked"))
    sources = boosted_hits.select("query_id", "source").distinct()
    # chunks of the boosted sources only, and no source is ever sorted: all steps are aggregates
    place = F.struct("chunk_index", F.col(key).alias("rec"))
    chunks = records.select(F.col("source_file").alias("source"), place.alias("place"), "text").join(sources.select("source").distinct(), "source", "left_semi")
    in_reach = sources.join(chunks, "source").join(asked, "query_id")
    score = F.size(F.filter("asked", lambda t: F.lower(F.col("text")).contains(t)))
    best = in_reach.groupBy("query_id", "source").agg(F.min(F.struct((-score).alias("s"), "place"))["place"].alias("best"))
    own = F.struct("place", "text")
    around = best.join(chunks, "source").groupBy("query_id", "source").agg(
        F.max(F.when(F.col("place") < F.col("best"), own)).alias("a"), F.min(F.when(F.col("place") == F.col("best"), own)).alias("b"), F.min(F.when(F.col("place") > F.col("best"), own)).alias("c")
    )
    wide = around.select("query_id", "source", F.substring(F.array_join(F.array("a.text", "b.text", "c.text"), "\n\n"), 1, most).alias("text"))
    return boosted_hits.select("query_id", key, "source").join(wide, ["query_id", "source"]).select("query_id", key, "text")


STRATEGIES = ("vector", "union")


def search(records: DataFrame, closets: DataFrame, queries: DataFrame, n: int = 5, max_distance: float = 0.0, strategy: str = "vector", key: str = "vec_id") -> DataFrame:
    """(query_id, key, score, rank): the whole pipeline.

    3 n nearest records, lifted by 2 n index hits, cut to n, texts of lifted
    ones widened, with "union" joined by 3 n lexical candidates (not under a
    distance limit), and ranked by vector and BM25 over the remaining texts.
    `records` (key, embedding, text, source_file, chunk_index), `closets`
    (closet_id, embedding, source_file), `queries` (query_id, embedding, text).
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
    near = nearest(records, queries, 3 * n, key).join(records.select(key, F.col("source_file").alias("source"), "chunk_index", "text"), key)
    if max_distance > 0:
        near = near.filter(F.col("distance") <= max_distance)
    index = nearest(closets, queries, 2 * n, "closet_id").join(closets.select("closet_id", F.col("source_file").alias("source")), "closet_id")
    lifted = boosted(near.drop("rank"), index)
    # n rows a query, read several times below
    cut = checkpointed(top(lifted, n, key, "effective", ascending=True).drop("rank"))
    wide = hydrated(cut.filter("boost > 0"), records, queries, key)
    hits = cut.join(wide.withColumnRenamed("text", "wide"), ["query_id", key], "left").select("query_id", key, "distance", F.coalesce("wide", "text").alias("text"), "source", "chunk_index")
    if strategy == "union" and max_distance <= 0:
        lexical = top(bm25_corpus(records, queries, key, "text").withColumn("bm25", F.round("bm25", 6)), 3 * n, key, "bm25").select("query_id", key)
        extra = lexical.join(records.select(key, "text", F.col("source_file").alias("source"), "chunk_index"), key).join(hits.select("query_id", "source", "chunk_index"), ["query_id", "source", "chunk_index"], "left_anti")
        hits = hits.unionByName(extra.select("query_id", key, F.lit(None).cast("double").alias("distance"), "text", "source", "chunk_index"))
    hits = checkpointed(hits)
    ranked = hybrid(hits, bm25(hits, queries, key, "text"), key).withColumn("score", F.round("score", 6))
    return top(ranked, n, key, "score").select("query_id", key, "score", "rank")


def lexical_search(records: DataFrame, queries: DataFrame, key: str, most: int = 500, n: int = 5, recency: str = "filed_at", text: str = "content", whole: bool = True) -> DataFrame:
    """(query_id, key, bm25, rank): BM25 over candidates that contain a query word of 3 characters or more.

    All of them are scored, by their own statistics. Where a query has no such
    word its candidates are the `most` latest records; a query that matches
    nothing stays empty. Not `whole`: at most `most` candidates a query, the
    latest, scored among themselves; that is the reference's bound of cost.
    """
    asked = queries.select("query_id", "text", F.filter(F.array_distinct(tokens(F.col("text"))), lambda t: F.char_length(t) >= 3).alias("asked"))
    records = records.select(key, text, recency)
    if whole:
        # one pass over the texts: each record's asked words with their counts, whatever the number of queries; no text is shuffled
        every = asked.select("query_id", "asked", F.array_distinct(tokens(F.col("text"))).alias("every"))
        vocabulary = every.select(F.explode("every").alias("word")).agg(F.collect_set("word").alias("vocabulary"))  # one row, of the queries' words
        count = lambda w: F.size(F.filter("words", lambda x: x == w))
        words = records.select(key, tokens(F.col(text)).alias("words")).join(F.broadcast(vocabulary))
        own = words.select(key, F.size("words").alias("length"), F.transform(F.array_intersect("words", "vocabulary"), lambda w: F.struct(w.alias("word"), count(w).alias("tf"))).alias("own")).filter(F.size("own") > 0)
        own = checkpointed(own)
        # shorter words make no candidate
        met = own.join(every, F.arrays_overlap("own.word", "asked")).select("query_id", key, "length", F.filter("own", lambda s: F.array_contains("every", s["word"])).alias("shared"))
        stats = met.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
        df = met.select("query_id", F.explode("shared.word").alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("df")).join(stats, "query_id")
        idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weights = df.groupBy("query_id", "mean").agg(F.map_from_entries(F.collect_list(F.struct("word", idf))).alias("idf"))  # a query's own words
        part = lambda s, x: s + F.col("idf")[x["word"]] * x["tf"] * 2.5 / (x["tf"] + 1.5 * (0.25 + 0.75 * F.col("length") / F.col("mean")))
        scored = met.join(weights, "query_id").select("query_id", key, F.aggregate("shared", F.lit(0.0), part).alias("bm25")).groupBy("query_id", key).agg(F.max("bm25").alias("bm25"))
        late = records.orderBy(F.desc_nulls_last(recency), key).limit(most)
        latest = bm25(asked.filter(F.size("asked") == 0).select("query_id").join(F.broadcast(late)).select("query_id", key, text), queries, key, text)
        scored = scored.unionByName(latest)
    else:
        word = asked.select("query_id", F.explode("asked").alias("word"))
        late = records.select(key, recency).orderBy(F.desc_nulls_last(recency), key).limit(most)
        without = asked.filter(F.size("asked") == 0).select("query_id").join(F.broadcast(late)).select("query_id", key, recency)
        own = records.select(key, recency, F.explode(F.array_distinct(tokens(F.col(text)))).alias("word"))
        met = own.join(word, "word").select("query_id", key, recency).dropDuplicates()
        order = W.partitionBy("query_id").orderBy(F.desc_nulls_last(recency), key)
        chosen = met.unionByName(without).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("query_id", key)
        scored = bm25(chosen.join(records.select(key, text), key), queries, key, text)
    # rounded first: sums of floats differ in their last bits by the order of rows
    scored = scored.withColumn("bm25", F.round("bm25", 6))
    return top(scored, n, key, "bm25").select("query_id", key, "bm25", "rank")
