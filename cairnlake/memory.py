"""A store of knowledge records and what is asked of it: the operators behind one object.

A store is a folder with versioned Parquet tables. Reads are DataFrames; a write makes a new version of a table and then is
the current one. There is one writer at a time; readers keep the version that they began with.
"""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CURATION, DECAY, RETRIEVAL
from .functions import privacy, text
from .operators import aggregates, curate, graph, mine, search, topics, verify
from .sources import store
from .sources.scratch import written
from .streaming import idle
from .streaming.inbox import current_version

RECORD = """bullet_id string, content string, user_id string, scope string, section string, knowledge_type string,
instructivity_score double, recall_count bigint, last_recall timestamp, decay_weight double, related_tools array<string>,
key_entities array<string>, tags array<string>, created_at timestamp, updated_at timestamp, deleted_at timestamp,
superseded_by string, verified_at timestamp, verified_status string, trust_score double"""
HISTORY = "bullet_id string, event string, content string, at timestamp"
EDGES = "from_id string, to_id string, edge_type string, weight double, updated_at timestamp"
TABLES = {"records": RECORD, "history": HISTORY, "edges": EDGES, "pages": topics.PAGE}


class Memory:
    def __init__(self, spark: SparkSession, path: str, custom_patterns=()) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.patterns = privacy.with_custom(custom_patterns)

    # ---- tables

    def table(self, name: str) -> DataFrame:
        version = current_version(self.spark, f"{self.path}/{name}")
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/v={version}")

    def write(self, name: str, df: DataFrame) -> None:
        version = current_version(self.spark, f"{self.path}/{name}")
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/v={0 if version is None else version + 1}")

    def _log(self, df: DataFrame, event: str, now) -> None:
        rows = df.select("bullet_id", F.lit(event).alias("event"), "content", now.alias("at"))
        version = current_version(self.spark, f"{self.path}/history") or 0
        rows.write.mode("append").parquet(f"{self.path}/history/v={version}")  # history only grows: no rewrite of what is there

    @staticmethod
    def _now(now=None):
        return F.lit(now or datetime.now(timezone.utc)).cast("timestamp")

    # ---- rows

    def get_all(self, user_id: str | None = None, scope: str | None = None) -> DataFrame:
        df = store.purge(self.table("records"))
        df = df.where(F.col("user_id") == user_id) if user_id else df
        return df.where(F.col("scope") == scope) if scope else df

    def get(self, bullet_id: str) -> DataFrame:
        return self.table("records").where(F.col("bullet_id") == bullet_id)

    def lookup(self, ids: list[str]) -> DataFrame:
        return store.lookup(self.table("records"), ids)

    def history(self, bullet_id: str) -> DataFrame:
        return self.table("history").where(F.col("bullet_id") == bullet_id).orderBy("at")

    def update(self, bullet_id: str, content: str, now=None) -> None:
        at = self._now(now)
        hit = F.col("bullet_id") == bullet_id
        df = self.table("records").withColumn("content", F.when(hit, privacy.redact(F.lit(content), self.patterns)).otherwise(F.col("content"))).withColumn("updated_at", F.when(hit, at).otherwise(F.col("updated_at")))
        self.write("records", df)
        self._log(self.get(bullet_id), "update", at)

    def delete(self, bullet_id: str, now=None) -> None:
        self._log(self.get(bullet_id), "delete", self._now(now))
        self.write("records", self.table("records").where(F.col("bullet_id") != bullet_id))

    def delete_all(self, user_id: str | None = None) -> None:
        df = self.table("records")
        self.write("records", store.erase_user(df, "user_id", user_id) if user_id else df.where("false"))

    erase_user = delete_all

    def reset(self) -> None:
        for name, schema in TABLES.items():
            self.write(name, self.spark.createDataFrame([], schema))

    def soft_delete(self, ids: DataFrame, now=None) -> None:
        gone = ids.select("bullet_id", F.lit(True).alias("_gone")).distinct()
        df = self.table("records").join(gone, "bullet_id", "left").withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("_gone"), self._now(now)))).drop("_gone")
        self.write("records", df)

    def purge_soft_deleted(self) -> None:
        self.write("records", store.purge(self.table("records")))

    # ---- ingest

    def add_records(self, df: DataFrame, now=None) -> DataFrame:
        """Candidates (content, scope and any record columns) after curation: merged into what they repeat, or added.

        All candidates of a record are merged into it, one after the other by id.
        Returns (cand_id, action, target_id, sim). Candidates that repeat each other are added once: the first by id stays."""
        at = self._now(now)
        old = self.table("records")
        live = store.purge(old)
        cands = df.withColumn("content", privacy.redact(F.col("content"), self.patterns)).withColumn("scope", F.coalesce("scope", F.lit("global"))).withColumn("cand_id", F.substring(F.sha2(F.concat_ws("|", "scope", "content"), 256), 1, 16)).dropDuplicates(["cand_id"])
        alone = curate.consolidate(cands.where("trim(content) <> ''"), "cand_id").where("role = 'kept'").select(F.col("id").alias("cand_id"))
        cands = written(cands.join(alone, "cand_id", "left_semi"))
        plan = written(curate.curate(cands.select("cand_id", "content", "scope"), live.select(F.col("bullet_id").alias("bullet_key"), "content", "scope")))
        have = set(cands.columns)
        col = lambda c, kind, default: (F.coalesce(F.col(c).cast(kind), default) if c in have else default.cast(kind)).alias(c)
        empty = F.array().cast("array<string>")
        defaults = {"section": F.lit("general"), "knowledge_type": F.lit("knowledge"), "instructivity_score": F.lit(50.0), "recall_count": F.lit(0), "decay_weight": F.lit(1.0), "created_at": at, "updated_at": at, "related_tools": text.known_tools(F.col("content")), "key_entities": text.entities(F.col("content")), "tags": empty}
        fields = [f.dataType.simpleString() for f in old.schema]
        added = cands.join(plan.where("action = 'add'").select("cand_id"), "cand_id", "left_semi")
        rows = added.select(*[F.col("cand_id").alias("bullet_id") if f.name == "bullet_id" else F.col(f.name) if f.name in ("content", "scope") else col(f.name, kind, defaults.get(f.name, F.lit(None))) for f, kind in zip(old.schema, fields)])
        hits = plan.where("action = 'merge'").select("cand_id", "target_id")
        side = cands.select("cand_id", "content", col("instructivity_score", "double", F.lit(50.0)).alias("score"), col("tags", "array<string>", empty).alias("tags"))
        mine_ = live.select(F.col("bullet_id").alias("target_id"), "content", F.col("instructivity_score").alias("score"), "tags")
        fresh = curate.merged_into(mine_, side, hits).select(F.col("target_id").alias("bullet_id"), F.col("content").alias("_c"), F.col("instructivity_score").alias("_s"), F.col("tags").alias("_t"))
        kept = old.join(fresh, "bullet_id", "left").withColumn("content", F.coalesce("_c", "content")).withColumn("instructivity_score", F.coalesce("_s", "instructivity_score")).withColumn("tags", F.coalesce("_t", "tags")).withColumn("updated_at", F.when(F.col("_c").isNotNull(), at).otherwise(F.col("updated_at"))).select(old.columns)
        self.write("records", kept.unionByName(rows))
        self._log(self.table("records").join(plan.where("action <> 'skip'").select(F.coalesce("target_id", "cand_id").alias("bullet_id")).distinct(), "bullet_id", "left_semi"), "add", at)
        return plan

    def add(self, messages: DataFrame, scope: str | None = None, user_id: str | None = None, now=None, **vocabularies) -> DataFrame:
        """Turns (conv_id, turn, role, text) mined for records; conversations without a pattern are kept as they are."""
        name = store.scope_name(scope)
        pairs = mine.parse_messages(messages).withColumn("turn_offset", F.lit(0).cast("long"))
        found = mine.reflect(pairs, **vocabularies)
        raw = pairs.join(found.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", F.concat_ws("\n", "user_message", "assistant_message").alias("content"))
        rows = found.select("conv_id", "content", "section", "knowledge_type", "instructivity_score").unionByName(raw, allowMissingColumns=True)
        return self.add_records(rows.drop("conv_id").withColumn("scope", F.lit(name)).withColumn("user_id", F.lit(user_id)), now)

    # ---- search

    def search(self, query: str, user_id: str | None = None, scope: str | None = None, limit: int = RETRIEVAL.max_results, semantic: DataFrame | None = None, files: DataFrame | None = None, anchors: DataFrame | None = None, policy: str = "flag", now=None) -> DataFrame:
        """Ranked records within the token budget; verified against files, if files and anchors are given."""
        at = self._now(now)
        out = search.search(self.get_all(user_id), query, at, scope, semantic, limit * RETRIEVAL.overfetch, limit)
        if files is not None and anchors is not None:
            mine_ = anchors.join(out.select(F.col("bullet_id").alias("id")), "id", "left_semi")
            checked = verify.check(mine_, files)
            out = verify.with_trust(out.withColumnRenamed("bullet_id", "id"), checked, at).withColumnRenamed("id", "bullet_id")
            out = search.stale_policy(out, policy)
        return out

    def search_graph(self, query: str, scope: str | None = None, limit: int = 20, now=None) -> DataFrame:
        live = self.get_all()
        base = search.top(search.scored(live, query, self._now(now), scope), limit).select("bullet_id", "final_score")
        return search.graph_search(base, live, self.table("edges"), limit=limit)

    def reinforce(self, log: DataFrame) -> None:
        """Recalls (bullet_id, ts) are counted."""
        self.write("records", aggregates.reinforce(self.table("records"), log, "bullet_id").select(self.table("records").columns))

    def record_co_recall(self, log: DataFrame, set_cols: list[str], now=None) -> None:
        fresh = graph.co_recall(log, set_cols, "bullet_id").select("from_id", "to_id", F.lit("co_recalled_with").alias("edge_type"), F.col("weight").alias("_w"))
        keys = ["from_id", "to_id", "edge_type"]
        both = self.table("edges").join(fresh, keys, "full").withColumn("updated_at", F.when(F.col("_w").isNotNull(), self._now(now)).otherwise(F.col("updated_at")))
        self.write("edges", both.withColumn("weight", F.least(F.lit(1.0), F.coalesce("weight", F.lit(0.0)) + F.coalesce("_w", F.lit(0.0)))).select(self.table("edges").columns))

    # ---- maintenance and reports

    def status(self) -> DataFrame:
        return aggregates.status(self.get_all())

    def detect_conflicts(self) -> DataFrame:
        return curate.conflicts(self.get_all(), "bullet_id")

    def consolidate_scan(self, similarity: float = CURATION.similarity) -> DataFrame:
        return curate.consolidate(self.get_all(), "bullet_id", similarity)

    def consolidate_run(self, similarity: float = CURATION.similarity, now=None) -> DataFrame:
        """Groups of near-duplicates become their winner; redundant rows are soft-deleted. Returns the roles."""
        roles = written(self.consolidate_scan(similarity))
        groups = roles.where("role in ('kept', 'member')").select(F.col("seed").alias("grp"), "id")
        sized = groups.join(groups.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp"), "grp", "left_semi")
        old = self.table("records")
        recs = old.withColumnRenamed("bullet_id", "id")
        won = written(curate.winners(sized, recs))
        out = curate.executed(recs, won, sized, roles.where("role = 'redundant'").select("id"), self._now(now))
        self.write("records", out.withColumnRenamed("id", "bullet_id").select(old.columns))
        return roles

    def run_decay_sweep(self, now=None, cfg=DECAY) -> DataFrame:
        """Weights as of now are written; returns the number of rows by outcome."""
        live = self.table("records").withColumn("current_weight", F.col("decay_weight"))
        swept = written(aggregates.sweep(live, self._now(now), cfg))
        self.write("records", swept.withColumn("decay_weight", F.col("new_weight")).select(self.table("records").columns))
        return swept.groupBy("outcome").agg(F.count("*").alias("n"))

    def verify(self, files: DataFrame, anchors: DataFrame, now=None) -> DataFrame:
        old = self.table("records")
        out = verify.with_trust(old.withColumnRenamed("bullet_id", "id"), verify.check(anchors, files), self._now(now)).withColumnRenamed("id", "bullet_id")
        self.write("records", out.select(old.columns))
        return aggregates.status_report(self.table("records"))

    def topics(self, edges: DataFrame | None = None) -> DataFrame:
        """Pages over communities of the edge table (ids as numbers from a hash, so any id works)."""
        e = edges if edges is not None else self.table("edges")
        records = self.get_all().select(F.col("bullet_id").alias("id"), "content")
        num = e.select(F.xxhash64("from_id").alias("from_id"), F.xxhash64("to_id").alias("to_id"), "weight")
        c = graph.clusters(graph.louvain(graph.adjacency(num))).select("cluster_id", F.explode("members").alias("n"))
        named = c.join(records.select("id", F.xxhash64("id").alias("n")), "n").groupBy("cluster_id").agg(F.array_sort(F.collect_list("id")).alias("members"))
        return topics.summarise(named, records)

    def refresh_topics(self, edges: DataFrame | None = None, now=None) -> DataFrame:
        """Stored pages brought up to date with the communities; the pages after it."""
        self.write("pages", topics.refreshed(self.table("pages"), written(self.topics(edges)), self._now(now)))
        return self.pages()

    def pages(self) -> DataFrame:
        return self.table("pages").orderBy(F.desc("updated_at"), "id")

    def delete_page(self, page_id: str) -> None:
        self.write("pages", self.table("pages").where(F.col("id") != page_id))

    def upkeep(self, batch=None, edges: DataFrame | None = None, log_path: str | None = None, now=None) -> dict:
        """One run of what is done while nobody works: waiting turns (``batch``, a function without arguments), consolidation,
        a block in the log, topic pages. Only a failed consolidation ends it."""
        at, began = self._now(now), time.monotonic()

        def consolidated() -> DataFrame:
            roles = self.consolidate_run(now=now)
            if log_path:
                groups = roles.where("role in ('kept', 'member')").select(F.col("seed").alias("grp"), "id")
                sized = groups.join(groups.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp"), "grp", "left_semi")
                none = self.spark.createDataFrame([], "action string")
                report = curate.execution_report(sized, sized.select("grp").distinct(), roles.where("role = 'redundant'"), none, time.monotonic() - began)
                store.append_log(report, log_path, at)
            return roles

        steps = [("batch", batch, False)] if batch is not None else []
        return idle.run_once([*steps, ("consolidate", consolidated, True), ("topics", lambda: self.refresh_topics(edges, now), False)])

    def export(self, path: str, fmt: str = "json", scope: str | None = None) -> None:
        (store.export_markdown if fmt == "markdown" else store.export_json)(self.get_all(), path, scope)

    def import_data(self, path: str) -> DataFrame:
        return self.add_records(store.import_json(self.spark, path, self.get_all().select("scope", "content")).drop("bullet_id"))

    def list(self, scope: str | None = None, knowledge_type: str | None = None, limit: int = 50) -> DataFrame:
        df = self.get_all(scope=scope)
        df = df.where(F.col("knowledge_type") == knowledge_type) if knowledge_type else df
        return df.orderBy(F.desc("instructivity_score"), "bullet_id").limit(limit)

    def conflicts_triaged(self) -> DataFrame:
        kind = F.when(F.col("reason") == "negation_asymmetry", "negation").otherwise("contradiction")
        return curate.triaged(self.detect_conflicts().withColumn("kind", kind))

    def team_index(self, scope: str | None = None) -> DataFrame:
        df = self.get_all(scope=scope).withColumn("tag", F.coalesce(F.try_element_at("tags", F.lit(1)), "section", F.lit("general")))
        row = F.struct((-F.col("recall_count")).alias("a"), F.col("created_at").alias("b"), F.col("content").alias("c"), F.concat(F.lit("- "), text.escape_markdown(F.col("content"))).alias("line"))
        lines = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["line"])
        return df.groupBy("tag").agg(F.concat(F.lit("## "), F.col("tag"), F.lit("\n"), F.array_join(lines, "\n")).alias("page"))


