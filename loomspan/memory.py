"""The store as one object: tables in a folder, and the operations callers use.

Each table is a folder of numbered versions; a write makes the next version
and then removes all but the last two, so a reader of the version before isn't
disturbed. Every method but the writes returns a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.text import sanitize_query
from loomspan.operators import facts as K
from loomspan.operators import graph as G
from loomspan.operators import predicates as P
from loomspan.operators import records as R
from loomspan.operators import retrieval as V
from loomspan.sources.store import log

SCHEMAS = {
    "drawers": "id string, content string, wing string, room string, hall string, source_file string, chunk_index int, added_by string, filed_at string, entities string, parent_drawer_id string, embedding array<float>",
    "closets": "id string, content string, source_file string, wing string, room string, embedding array<float>",
    "entities": "id string, name string, type string, properties string, created_at timestamp",
    "triples": "id string, subject string, predicate string, object string, valid_from string, valid_to string, confidence double, source_file string, extracted_at timestamp",
    "tunnels": "id string, source_wing string, source_room string, target_wing string, target_room string, label string, kind string, created_at timestamp, updated_at timestamp, strength double, stability double, last_activated timestamp, access_count bigint",
    "hallways": "id string, wing string, entity_a string, entity_b string, n bigint, rooms array<string>, label string, created_at timestamp, strength double, stability double, last_activated timestamp, access_count bigint",
    "diary": "id string, agent string, wing string, topic string, filed_at timestamp, chunk_index int, content string",
}
DYNAMICS = ["strength", "stability", "last_activated", "access_count"]
#: Bounds of the number of results of one call.
MOST_RESULTS = 100


class InvalidArgument(ValueError):
    """A call with an argument that isn't known or doesn't fit."""


def clamp(n: int, most: int = MOST_RESULTS) -> int:
    return max(1, min(int(n), most))


class Memory:
    """`embed` maps a DataFrame with a text column `text` to one with `embedding`; without it search is lexical."""

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.folder, self.embed = spark, folder.rstrip("/"), embed

    # ---- tables ---------------------------------------------------------

    def _versions(self, name: str) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def table(self, name: str) -> DataFrame:
        """The last version; an empty table before the first write."""
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}/v{versions[-1]}")

    def write(self, name: str, rows: DataFrame) -> None:
        versions = self._versions(name)
        columns = [F.col(c.split()[0]).cast(c.split(None, 1)[1]) if c.split()[0] in rows.columns else F.lit(None).cast(c.split(None, 1)[1]).alias(c.split()[0]) for c in SCHEMAS[name].split(", ")]
        rows.select(*columns).write.parquet(f"{self.folder}/{name}/v{versions[-1] + 1 if versions else 1}")
        jvm = self.spark._jvm
        for old in versions[:-1]:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/v{old}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _log(self, operation: str, params: dict, result: str = "ok") -> None:
        log(self.spark, f"{self.folder}/log", operation, params, result)

    # ---- records --------------------------------------------------------

    def status(self) -> DataFrame:
        return R.counts(self.table("drawers"))

    def list_wings(self) -> DataFrame:
        return R.counts(self.table("drawers")).filter("level = 'wing'").select("wing", "n")

    def list_rooms(self, wing: str | None = None) -> DataFrame:
        own = self.table("drawers").filter(P.where_column(P.scope(wing)))
        return R.counts(own).filter("level = 'room'").select("room", "n")

    def taxonomy(self) -> DataFrame:
        return R.taxonomy_tree(self.table("drawers"))

    def add_drawer(self, wing: str, room: str, content: str, source_file: str | None = None, added_by: str = "api", filed_at: str | None = None) -> int:
        """Files a text; returns the number of rows added, 0 where it is filed already."""
        for name, v in (("wing", wing), ("room", room)):
            if not v or not v.strip() or len(v) > 128 or any(x in v for x in ("..", "/", "\\", "\x00")):
                raise InvalidArgument(f"{name} isn't a usable name: {v!r}")
        if not content or not content.strip() or len(content) > 100_000 or "\x00" in content:
            raise InvalidArgument("content must be text of 1 to 100,000 characters")
        row = self.spark.createDataFrame([(wing, room, content, source_file, added_by, filed_at)], "wing string, room string, content string, source_file string, added_by string, filed_at string")
        return self.add_drawers(row)

    def add_drawers(self, added: DataFrame) -> int:
        """The same for many (wing, room, content, source_file, added_by, filed_at)."""
        stored = self.table("drawers")
        new = R.filed(stored, added)
        if self.embed:
            new = self.embed(new.withColumn("text", F.col("content"))).drop("text")
        before = stored.count()
        self.write("drawers", stored.unionByName(new, allowMissingColumns=True))
        n = self.table("drawers").count() - before
        self._log("add_drawers", {"rows": n})
        return n

    def get_drawer(self, drawer_id: str) -> DataFrame:
        file = F.element_at(F.split("source_file", r"[/\\]"), -1)
        return self.table("drawers").filter(F.col("id") == drawer_id).withColumn("source_file", file)

    def get(self, **spec) -> DataFrame:
        known = {"ids", "where", "where_document", "limit", "offset", "include"}
        if set(spec) - known:
            raise InvalidArgument(f"unknown arguments {sorted(set(spec) - known)}")
        return P.get(self.table("drawers"), **spec)

    def list_drawers(self, wing: str | None = None, room: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        own = self.table("drawers").select("id", "wing", "room", F.substring("content", 1, 200).alias("preview"))
        return P.page_with_total(own, P.scope(wing, room), clamp(limit), max(0, int(offset)))

    def update_drawer(self, drawer_id: str, **values) -> None:
        """Sets the given columns; None leaves one as it is, all None change nothing."""
        own = {k: v for k, v in values.items() if v is not None}
        if set(own) - {"content", "wing", "room", "hall", "source_file"}:
            raise InvalidArgument(f"no such columns: {sorted(own)}")
        if own:
            change = self.spark.createDataFrame([(drawer_id, *own.values())], "id string, " + ", ".join(f"{k} string" for k in own))
            self.write("drawers", R.updated(self.table("drawers"), change))
            self._log("update_drawer", {"id": drawer_id, **own})

    def delete_drawer(self, drawer_id: str) -> None:
        gone = self.spark.createDataFrame([(drawer_id,)], "id string")
        self.write("drawers", R.without(self.table("drawers"), gone))
        self._log("delete_drawer", {"id": drawer_id})

    def sync(self, roots: list[str], live: DataFrame, apply: bool = False) -> DataFrame:
        """(bucket, n); with `apply` missing and ignored records and their closets are removed."""
        if apply and not roots:
            raise InvalidArgument("pruning needs roots")
        marked = R.pruning(self.table("drawers"), roots, live)
        report = marked.groupBy("bucket").agg(F.count("*").alias("n"))
        if apply:
            report = self.spark.createDataFrame(report.collect(), report.schema)  # five rows, before the table changes
            gone = marked.filter("bucket in ('missing', 'gitignored')").select("source_file").distinct()
            closets = self.table("closets").join(gone, "source_file", "left_anti")
            self.write("closets", closets)
            self.write("drawers", marked.filter("bucket not in ('missing', 'gitignored')").drop("bucket"))
            self._log("sync", {"roots": roots})
        return report

    # ---- search ---------------------------------------------------------

    def search(self, query: str, wing: str | None = None, room: str | None = None, limit: int = 5, max_distance: float = 1.5, strategy: str = "vector", vector_disabled: bool = False) -> DataFrame:
        """(id, score, rank) of a question; lexical where there are no vectors."""
        if strategy not in V.STRATEGIES:
            raise InvalidArgument(f"strategy must be one of {V.STRATEGIES}")
        clean, _ = sanitize_query(query)
        if not clean.strip():
            raise InvalidArgument("the query is empty")
        own = self.table("drawers").filter(P.where_column(P.scope(wing, room)))
        asked = self.spark.createDataFrame([(1, clean)], "query_id long, text string")
        if vector_disabled or not self.embed:
            return V.lexical_search(own, asked, "id", n=clamp(limit)).select("id", F.col("bm25").alias("score"), "rank")
        text = own.select("id", "embedding", F.coalesce("content", F.lit("")).alias("text"), F.coalesce("source_file", F.lit("")).alias("source_file"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"))
        closets = self.table("closets").filter(P.where_column(P.scope(wing, room))).select(F.col("id").alias("closet_id"), "embedding", "source_file")
        return V.search(text, closets, self.embed(asked), clamp(limit), 0.0 if strategy == "union" else max_distance, strategy, "id").select("id", "score", "rank")

    def check_duplicate(self, content: str, threshold: float = 0.9) -> DataFrame:
        """(id, similarity) of the five nearest records that are as similar as the threshold."""
        if not self.embed:
            raise InvalidArgument("needs embeddings")
        asked = self.embed(self.spark.createDataFrame([(1, content)], "query_id long, text string"))
        near = V.nearest(self.table("drawers"), asked, 5, "id")
        return near.select("id", F.round(1 - F.col("distance"), 3).alias("similarity")).filter(F.col("similarity") >= threshold)

    # ---- facts ----------------------------------------------------------

    def kg_add(self, subject: str, predicate: str, obj: str, valid_from: str | None = None, valid_to: str | None = None, confidence: float = 1.0) -> int:
        added = self.spark.createDataFrame([(subject, predicate, obj, valid_from, valid_to)], "subject string, predicate string, object string, valid_from string, valid_to string").withColumn("extracted_at", F.current_timestamp())
        stored = self.table("triples")
        new = K.new_triples(stored, added).withColumn("confidence", F.lit(confidence))
        before = stored.count()
        self.write("triples", stored.unionByName(new, allowMissingColumns=True))
        names = self.spark.createDataFrame([(subject,), (obj,)], "name string").select(K.entity_id(F.col("name")).alias("id"), "name", F.lit("unknown").alias("type"), F.current_timestamp().alias("created_at"))
        entities = self.table("entities")
        self.write("entities", entities.unionByName(names.dropDuplicates(["id"]).join(entities.select("id"), "id", "left_anti"), allowMissingColumns=True))
        n = self.table("triples").count() - before
        self._log("kg_add", {"subject": subject, "predicate": predicate, "object": obj})
        return n

    def kg_query(self, name: str, as_of: str | None = None, direction: str = "both") -> DataFrame:
        return K.entity_facts(self.table("triples"), self.table("entities"), self.spark.createDataFrame([(name,)], "name string"), direction, as_of)

    def kg_relationship(self, predicate: str, as_of: str | None = None) -> DataFrame:
        return K.relationship(self.table("triples"), self.table("entities"), predicate, as_of)

    def kg_invalidate(self, subject: str, predicate: str, obj: str, ended: str | None = None) -> None:
        self.write("triples", K.invalidated(self.table("triples"), subject, predicate, obj, ended or date.today().isoformat()))
        self._log("kg_invalidate", {"subject": subject, "predicate": predicate, "object": obj})

    def kg_timeline(self, name: str | None = None) -> DataFrame:
        return K.timeline(self.table("triples"), self.table("entities"), name)

    def kg_stats(self) -> DataFrame:
        return K.stats(self.table("triples"), self.table("entities"))

    def check_text(self, text: str, today: str | None = None) -> DataFrame:
        said = self.spark.createDataFrame([("1", text)], "text_id string, text string")
        return K.contradictions(said, self.table("triples"), self.table("entities"), today or date.today().isoformat())

    # ---- graph ----------------------------------------------------------

    def nodes(self) -> DataFrame:
        return G.room_nodes(self.table("drawers").select("id", "room", "wing", "hall", F.substring("filed_at", 1, 10).alias("date")))

    def traverse(self, room: str, max_hops: int = 2) -> DataFrame:
        return G.walk(self.nodes(), room, max_hops)

    def find_tunnels(self, wing_a: str | None = None, wing_b: str | None = None) -> DataFrame:
        return G.tunnel_rooms(self.nodes(), wing_a, wing_b)

    def graph_stats(self) -> DataFrame:
        return G.graph_stats(self.nodes())

    def create_tunnel(self, source_wing: str, source_room: str, target_wing: str, target_room: str, label: str = "", kind: str = "explicit") -> str:
        """Makes or refreshes a tunnel; an explicit one needs both rooms to have records. Returns its id."""
        ends = [(source_wing, source_room), (target_wing, target_room)]
        if any(not x or not x.strip() for end in ends for x in end):
            raise InvalidArgument("wings and rooms must have names")
        if kind == "explicit":
            for wing, room in ends:
                if not self.table("drawers").filter((F.col("wing") == wing) & (F.col("room") == room)).limit(1).collect():
                    raise InvalidArgument(f"no records in {wing}/{room}")
        added = self.spark.createDataFrame([(*ends[0], *ends[1], label, kind)], "source_wing string, source_room string, target_wing string, target_room string, label string, kind string").withColumn("at", F.current_timestamp())
        merged = G.upserted_tunnels(self.table("tunnels"), added)
        self.write("tunnels", merged)
        self._log("create_tunnel", {"kind": kind})
        return added.select(G.tunnel_id(G.slug(F.col("source_wing")), F.col("source_room"), G.slug(F.col("target_wing")), F.col("target_room")).alias("id")).first().id

    def list_tunnels(self, wing: str | None = None) -> DataFrame:
        own = self.table("tunnels")
        if not wing:
            return own
        w = wing.lower().replace(" ", "_").replace("-", "_")
        return own.filter((G.slug(F.col("source_wing")) == w) | (G.slug(F.col("target_wing")) == w))

    def delete_tunnel(self, tunnel_id: str) -> None:
        self.write("tunnels", self.table("tunnels").filter(F.col("id") != tunnel_id))
        self._log("delete_tunnel", {"id": tunnel_id})

    def follow_tunnels(self, wing: str, room: str) -> DataFrame:
        return G.followed(self.table("tunnels"), wing, room)

    def compute_hallways(self, least: int = 2) -> None:
        """Counts pairs of entities anew; the dynamics of pairs that stay are kept."""
        found = G.cooccurrences(self.table("drawers").select("id", "wing", "room", "entities"), least).withColumn("created_at", F.current_timestamp())
        kept = self.table("hallways").select("id", *[F.col(c).alias(f"_{c}") for c in DYNAMICS])
        joined = G.with_dynamics(found).join(kept, "id", "left")
        self.write("hallways", joined.select(*[c for c in joined.columns if c not in DYNAMICS and not c.startswith("_")], *[F.coalesce(f"_{c}", c).alias(c) for c in DYNAMICS]))

    def list_hallways(self, wing: str | None = None) -> DataFrame:
        return self.table("hallways") if wing is None else self.table("hallways").filter(F.col("wing") == wing)

    def delete_hallway(self, hallway_id: str) -> None:
        self.write("hallways", self.table("hallways").filter(F.col("id") != hallway_id))

    def compute_entity_tunnels(self, wing: str | None = None) -> int:
        """Tunnels between wings whose hallways share an entity; returns how many there are."""
        found = G.entity_tunnels(self.table("hallways"), wing)
        added = found.select(F.col("wing_a").alias("source_wing"), F.col("room").alias("source_room"), F.col("wing_b").alias("target_wing"), F.col("room").alias("target_room"), "label", "kind", F.current_timestamp().alias("at"))
        self.write("tunnels", G.upserted_tunnels(self.table("tunnels"), added))
        return self.table("tunnels").filter("kind = 'entity'").count()

    def potentiate(self, accesses: DataFrame, table: str = "tunnels") -> None:
        """Strengthens connections by accesses (id, at)."""
        self.write(table, G.potentiated(self.table(table), accesses))

    def decay_pass(self, now: str) -> DataFrame:
        """Mean strength and counts at floor and ceiling at a time; stored strengths stay, so a repeat gives the same."""
        edges = self.table("tunnels").select(*DYNAMICS).unionByName(self.table("hallways").select(*DYNAMICS))
        return G.decay_stats(edges, F.to_timestamp(F.lit(now)))

    # ---- diary ----------------------------------------------------------

    def diary_write(self, agent: str, entry: str, topic: str = "general") -> int:
        rows = R.diary_rows(self.spark.createDataFrame([(agent, entry, topic)], "agent string, entry string, topic string").withColumn("at", F.current_timestamp()))
        stored = self.table("diary")
        before = stored.count()
        self.write("diary", stored.unionByName(rows))
        self._log("diary_write", {"agent": agent, "entry": entry})
        return self.table("diary").count() - before

    def diary_read(self, agent: str, last_n: int = 10, wing: str | None = None) -> DataFrame:
        own = self.table("diary").filter(F.col("agent") == agent.strip().lower())
        own = own if wing is None else own.filter(F.col("wing") == wing)
        return own.orderBy(F.desc("filed_at"), "id").limit(clamp(last_n))

    # ---- layers ---------------------------------------------------------

    def wake_up(self, wing: str | None = None, identity: str = "") -> str:
        """Identity and the essential story as text: 15 lines and 3,200 characters at most."""
        own = self.table("drawers").filter(P.where_column(P.scope(wing)))
        rows = R.essential_story(own, F.lit(None).cast("double")).orderBy("rank").collect()
        out, room = [identity or "## No identity", "", "## Essential story"], None
        for r in rows:
            if r.room != room:
                room = r.room
                out.append(f"\n[{room}]")
            out.append(r.line)
        return "\n".join(out if rows else [*out[:2], "## No memories yet."])

    def recall(self, wing: str | None = None, room: str | None = None, limit: int = 10) -> DataFrame:
        own = self.table("drawers").filter(P.where_column(P.scope(wing, room)))
        return own.select("id", "room", F.substring("content", 1, 300).alias("snippet")).orderBy("id").limit(clamp(limit))
