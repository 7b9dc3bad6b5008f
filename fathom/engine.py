"""The engine over a vault: index, search, ask, graph, overview, distill, evaluate. Thin: operators do the work."""

from __future__ import annotations

import datetime
from dataclasses import replace
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.config import EngineConfig
from fathom.functions.text import preview
from fathom.operators import answer, bm25, community, dense, evaluate, fusion, graph
from fathom.operators.ann import AnnIndex
from fathom.operators.segments import SegmentedIndex
from fathom.operators.store import UnitStore, load_graph, save_graph
from fathom.providers import Embedder, Generator, cached, embed_column, extractive_generator, generate_column, hashing_embedder, local_embedder, local_generator, tokenizers
from fathom.sources import vault
from fathom.storage import Workspace, table_if_there
from fathom.streaming.incremental import units_of

SUMMARY = "community_summary"


class Engine:
    """Without an embedder or generator the configuration's provider decides: the built-in stand-ins, or a local model
    server."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, embedder: Embedder | None = None, generator: Generator | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        c = self.config
        served = c.provider == "server"
        self.embedder = embedder or (local_embedder(c.base_url, c.embedding_model) if served else hashing_embedder())
        self.generator = generator or (local_generator(c.base_url, c.generation_model) if served else extractive_generator())
        self.tokenizer = tokenizers()[c.tokenizer]
        self.store = UnitStore(spark, c.store_path)

    @property
    def threshold(self) -> float:
        """The configured least similarity of evidence, else the embedder's own."""
        own = getattr(self.embedder, "threshold", EngineConfig.THRESHOLD)
        return own if self.config.relevance_threshold is None else self.config.relevance_threshold

    def notes(self) -> DataFrame:
        return vault.parse_notes(vault.scan(self.spark, self.config.vault_path))

    def _units(self, notes: DataFrame) -> DataFrame:
        return units_of(notes, self.embedder, self.config.chunk_size, self.config.chunk_overlap)

    def index(self, public_only: bool = False) -> int:
        """Replace all chunks by those of the vault; summaries stay. A public-only index needs a store path of its own."""
        if public_only and self.config.store_path == EngineConfig().store_path:
            raise ValueError("a public-only index must not go to the default store path")
        notes = self.notes()
        self.store.replace(self._units(notes.where("public") if public_only else notes))
        self.words().rebuild(self.store.read())
        if self.config.vector_search == "ann":
            self.vectors().build(self.store.read())
        return self.store.read("").count()

    def words(self) -> SegmentedIndex:
        """The BM25 index of all units, beside the store; it is made if it is not there."""
        index = SegmentedIndex(self.spark, f"{self.config.store_path.rstrip('/')}/bm25", self.tokenizer)
        if not index.exists():
            index.rebuild(self.store.read())
        return index

    def vectors(self) -> AnnIndex:
        """The approximate vector index of all units, beside the store."""
        return AnnIndex(self.spark, f"{self.config.store_path.rstrip('/')}/ann")

    def _added(self, units: DataFrame) -> None:
        """Units that came into the store go into the vector index, if it is in use."""
        if self.config.vector_search == "ann" and self.vectors().exists():
            self.vectors().add(units)

    def nearest(self, asked: DataFrame, units: DataFrame, k: int) -> DataFrame:
        """(query, unit, score, rank) as configured: exact, or from the vector index if there is one."""
        if self.config.vector_search == "ann" and self.vectors().exists():
            return self.vectors().search(asked, units, k, "unit", query_id_col="query")
        return dense.dense_search(units, asked, k, "unit", query_id_col="query")

    def _queries(self, texts: list[str]) -> DataFrame:
        rows = [(i, t) for i, t in enumerate(texts)]
        return embed_column(self.spark.createDataFrame(rows, "query int, text string"), self.embedder)

    def _lists(self, asked: DataFrame, units: DataFrame, many: int, with_graph: bool) -> dict[str, DataFrame]:
        """The ranked list of each signal; the graph's only if it is asked for and there is one."""
        c = self.config
        lists = {"dense": self.nearest(asked, units, many), "bm25": self.words().search(asked, many, "query", "text")}
        loaded = load_graph(self.spark, c.graph_path) if with_graph else None
        if loaded is not None:
            work = Workspace(self.spark, "lists")
            lists = {n: work.table(df, n) for n, df in lists.items()}  # read for the seeds and for the fusion
            notes = fusion.signals(**lists).join(units.where(F.col("kind") == SUMMARY).select("unit"), "unit", "left_anti")
            seeds = fusion.fuse(notes, self._weights(c, lists), many, c.rrf_k).join(units.select("unit", "source"), "unit")
            seeds = bm25.top_k(seeds.groupBy("query", F.col("source").alias("unit")).agg(F.max("score").alias("score")), c.graph_seed_notes)
            near = graph.proximity(seeds.select("query", F.col("unit").alias("node")), loaded[1], c.graph_hops, work)
            first = units.where("kind = ''").groupBy(F.col("source").alias("node")).agg(F.min_by("unit", "chunk_index").alias("unit"))
            lists["graph"] = bm25.top_k(near.join(first, "node"), 1 << 30)
        return lists

    @staticmethod
    def _weights(c: EngineConfig, lists: dict[str, DataFrame]) -> dict[str, float]:
        """A configuration's weights of the lists that it uses: the graph's counts only with a weight."""
        weights = {"dense": c.dense_weight, "bm25": c.bm25_weight}
        return weights | ({"graph": c.graph_weight} if "graph" in lists and c.graph_weight else {})

    def search(self, texts: list[str], k: int = 5) -> DataFrame:
        """(query, rank, unit, source, header_path, text, preview, score, dense_rank, bm25_rank, graph_rank, kind, community_id)."""
        c, k = self.config, EngineConfig.clamp_k(k)
        units = self.store.read().withColumnRenamed("unit_id", "unit")
        asked, many = self._queries(texts), EngineConfig.candidate_k(k)
        summaries = units.where(F.col("kind") == SUMMARY).select("unit")
        lists = self._lists(asked, units, many, bool(c.graph_weight))
        weights = self._weights(c, lists)
        fused = fusion.fuse(fusion.signals(**lists), weights, k, c.rrf_k, summaries, c.summary_weight)
        if "graph_rank" not in fused.columns:
            fused = fused.withColumn("graph_rank", F.lit(None).cast("int"))
        found = fusion.hydrate(fused, units, "source", "header_path", "text", "kind", "community_id")
        return found.withColumn("preview", preview(F.col("text")))

    def ask(self, texts: list[str], k: int = 5) -> DataFrame:
        asked, units = self._queries(texts), self.store.read("").withColumnRenamed("unit_id", "unit")
        top = dense.top_similarity(self.nearest(asked, units, 5))
        return answer.answers(asked, self.search(texts, k), top, self.generator, self.threshold)

    def agentic(self, text: str, k: int = 5, max_iterations: int = 2) -> answer.AgentState:
        def retrieve(q: str) -> str:
            row = answer.contexts(self.search([q], k)).first()
            return row["context"] if row else ""

        return answer.agentic(text, retrieve, self.generator, max_iterations)

    def _remembered(self, work: Workspace, prompts: DataFrame, name: str, keep_all: bool) -> tuple[DataFrame, dict[str, int]]:
        """(key, answer) for rows (key, prompt), and counters. Answers are kept beside the graph, by key: what was told
        before is not asked again. keep_all also keeps answers whose key is not in use now."""
        path = f"{self.config.graph_path}/cache-{name}"
        kept = table_if_there(self.spark, path)
        kept = self.spark.createDataFrame([], "key string, answer string") if kept is None else work.table(kept, f"{name}-kept")
        prompts = work.table(prompts.groupBy("key").agg(F.min("prompt").alias("prompt")), f"{name}-prompts")
        told = work.table(cached(prompts, kept, "key", lambda missing: generate_column(missing, self.generator)), f"{name}-told")
        stored = told.unionByName(kept.join(told, "key", "left_anti")) if keep_all else told
        stored.write.mode("overwrite").parquet(path)
        total, hits = prompts.count(), kept.join(prompts, "key", "left_semi").count()
        return told, {"cached": hits, "asked": total - hits, "failed": total - told.count()}

    def build_graph(self) -> dict:
        """Backbone, entities, communities and their summaries; saves the graph and the summary units."""
        work = Workspace(self.spark, "graph")
        notes = self.notes()
        edges, unresolved = graph.backbone(notes)
        told, extraction = self._remembered(work, notes.select(F.col("content_sha").alias("key"), F.concat(F.lit("ENTITIES\n\n\n"), F.substring("body", 1, 6000)).alias("prompt")), "entities", True)
        entities = graph.entity_edges(notes.select("source", F.col("content_sha").alias("key")).join(told, "key").select("source", F.col("answer").alias("raw")))
        edges = work.table(graph.strongest(edges.withColumn("label", F.lit(None).cast("string")).unionByName(entities)), "edges")
        found = community.communities(edges, work)
        ends = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).where("startswith(id, 'entity::')").distinct()
        nodes = notes.select(F.col("source").alias("id"), F.lit("note").alias("kind"), "title", F.lit(None).cast("string").alias("name")).unionByName(ends.select("id", F.lit("entity").alias("kind"), F.lit(None).cast("string").alias("title"), F.substring("id", 9, 1 << 20).alias("name")))
        names = found.select("community").distinct()
        numbered = work.table(names.select("community", (F.row_number().over(Window.orderBy("community")) - 1).alias("community_id")), "numbered")
        nodes = work.table(nodes.join(found.withColumnRenamed("node", "id"), "id", "left").join(numbered, "community", "left").drop("community"), "nodes")
        save_graph(nodes, edges, self.config.graph_path)
        members = graph.community_members(nodes).where("note_count > 0")
        prompt = F.concat(F.lit("SUMMARY\n\n\n"), F.array_join(F.slice("titles", 1, 40), ", "), F.lit(". "), F.array_join(F.slice("entities", 1, 30), ", "))
        members = work.table(members.select("community_id", F.col("note_count").cast("int").alias("note_count"), F.col("member_hash").alias("key"), prompt.alias("prompt")), "members")
        summaries, summarised = self._remembered(work, members.select("key", "prompt"), "summaries", False)
        texts = members.join(summaries, "key")
        units = texts.select(F.concat(F.lit(f"{SUMMARY}::"), F.col("community_id")).alias("unit_id"), F.concat(F.lit("<community-"), F.col("community_id"), F.lit(">")).alias("source"), F.lit("").alias("header_path"), F.col("answer").alias("text"), "community_id", "note_count")
        old = self.store.read(SUMMARY).select("source").distinct() if SUMMARY in self.store.kinds() else units.select("source").limit(0)
        old = work.table(old, "old-summaries")
        self.store.replace(embed_column(units, self.embedder), SUMMARY)
        fresh = self.store.read(SUMMARY)
        self.words().upsert(fresh, old.unionByName(fresh.select("source")))
        self._added(fresh)
        counts = {"nodes": nodes.count(), "edges": edges.count(), "entities": nodes.where("kind = 'entity'").count(), "unresolved": unresolved.count(), "isolated": graph.isolated(nodes.where("kind = 'note'"), edges).count(), "communities": numbered.count()}
        return counts | {"extraction": extraction, "summaries": summarised}

    def overview(self, text: str) -> dict:
        """The exhaustive answer over the summaries of the communities as they are in the graph now. `missing`: communities
        with notes whose summary is not there."""
        loaded = load_graph(self.spark, self.config.graph_path)
        if loaded is None:
            return answer.exhaustive(text, self.store.read(SUMMARY).select("community_id", "text"), self.generator) | {"missing": 0}
        members = graph.community_members(loaded[0]).where("note_count > 0").select("community_id", F.col("member_hash").alias("key"))
        kept = table_if_there(self.spark, f"{self.config.graph_path}/cache-summaries")
        kept = self.spark.createDataFrame([], "key string, answer string") if kept is None else kept
        found = members.join(kept, "key").select("community_id", F.col("answer").alias("text"))
        return answer.exhaustive(text, found, self.generator) | {"missing": members.join(kept, "key", "left_anti").count()}

    def evaluate(self, gold: DataFrame, k: int = 20) -> dict[str, DataFrame]:
        """Results of a gold set (query, question, expected, category): `methods` by method and segment (grep, dense, bm25,
        flat: fused without graph and summaries, integrated: as configured), `changes` from flat to integrated, and
        `sweeps` over graph and summary weights. Also `regressed`, a one-row table."""
        work = Workspace(self.spark, "evaluation")
        gold = work.table(gold, "gold")
        texts = [r["question"] for r in gold.orderBy("query").collect()]
        units = self.store.read().withColumnRenamed("unit_id", "unit")
        asked, many = self._queries(texts), EngineConfig.candidate_k(k)
        sources = units.select("unit", "source")

        def hits(ranked: DataFrame, method: str) -> DataFrame:
            return work.table(evaluate.first_hits(gold, ranked).withColumn("method", F.lit(method)), method)

        def by_unit(ranked: DataFrame, method: str) -> DataFrame:
            return hits(evaluate.distinct_sources(ranked.join(sources, "unit")), method)

        files = vault.scan(self.spark, self.config.vault_path).withColumnRenamed("raw", "text")
        grep = evaluate.grep(files, gold.select("query", F.col("question").alias("text")), k)
        c = self.config
        lists = {n: work.table(df, n) for n, df in self._lists(asked, units, many, True).items()}
        configs = [("flat", replace(c, graph_weight=0.0, summary_weight=0.0)), ("integrated", c), *evaluate.sweep_settings(c)]
        settings = [row for name, own in configs for row in fusion.setting(name, self._weights(own, lists), own.summary_weight)]
        ranks = fusion.marked(fusion.signals(**lists), units.where(F.col("kind") == SUMMARY).select("unit"))
        fused = fusion.sweep(ranks, self.spark.createDataFrame(settings, "setting string, signal string, weight double"), EngineConfig.clamp_k(k), c.rrf_k)
        results = work.table(evaluate.first_hits_by_setting(gold, fused.join(sources, "unit"), [name for name, _ in configs]), "fused")
        flat, whole = (results.where(F.col("method") == name) for name in ("flat", "integrated"))
        rows = hits(grep.select("query", "source", "rank"), "grep").unionByName(by_unit(lists["dense"], "dense")).unionByName(by_unit(lists["bm25"], "bm25"))
        rows = rows.unionByName(flat.select(*rows.columns)).unionByName(whole.select(*rows.columns))
        sweeps = evaluate.segments(results.where(~F.col("method").isin("flat", "integrated")))
        regressed = self.spark.createDataFrame([(evaluate.regressed(flat, whole),)], "regressed boolean")
        return {"methods": evaluate.segments(rows), "changes": evaluate.rank_changes(flat, whole), "sweeps": sweeps.withColumnRenamed("method", "setting"), "regressed": regressed}

    def distill(self, topic: str, k: int = 8, date: str | None = None, write: bool = False) -> dict:
        """A note about a topic; with write it goes into the vault (never over another note) and into the store."""
        date = datetime.date.today().isoformat() if date == "today" else date
        topics = self.spark.createDataFrame([(0, topic, date)], "query int, topic string, date string")
        note = answer.distill(topics, self.search([topic], k), self.notes().select("title"), self.generator).first().asDict()
        if write and not note["no_evidence"]:
            note["source"] = self._write_note(note["filename"], note["note"])
            raw = self.spark.createDataFrame([(note["source"], note["note"])], "source string, raw string")
            words = self.words()
            self.store.upsert(self._units(vault.parse_notes(raw)))
            fresh = self.store.read("").where(F.col("source") == note["source"])
            words.upsert(fresh, raw)
            self._added(fresh)
        return note

    def _write_note(self, filename: str, text: str) -> str:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.config.vault_path}/{self.config.wiki_dir}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        stem, n = PurePosixPath(filename).stem, 0
        while True:
            name = filename if not n else f"{stem}.new{'' if n == 1 else n}.md"
            target = hadoop.Path(folder, name)
            if not fs.exists(target):
                break
            n += 1
        out = fs.create(target, False)
        out.write(bytearray(text.encode()))
        out.close()
        return f"{self.config.wiki_dir}/{name}"
