"""All registered queries of the library, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import text as tx
from fathom.operators import ann, answer, chunking, community, components, dense, evaluate, fusion, graph, segments, store
from fathom.providers import extractive_generator
from fathom.sources import vault
from fathom.storage import Workspace
from fathom.streaming import incremental

from . import fixtures as fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "rrf_hybrid"
QUERY, K, CANDIDATES = "that thing onesen", 10, 30
WEIGHTS = {"dense": 1.0, "bm25": 0.7}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


# --- SQL parts ---------------------------------------------------------------------------------------------------
_WS = r"'[ \t\n\r\f\x0B]+'"
_TRIM = r"E' \t\n\r\f' || chr(11)"
_WORDS = f"SELECT doc_id AS unit, unnest(string_split_regex(lower(text), {_WS})) AS token FROM documents"
_INDEX = f"""
    w AS (SELECT * FROM ({_WORDS}) WHERE token <> ''),
    tf AS (SELECT unit, token, count(*) AS tf FROM w GROUP BY ALL),
    dl AS (SELECT d.doc_id AS unit, count(w.token) AS dl FROM documents d LEFT JOIN w ON w.unit = d.doc_id GROUP BY 1),
    st AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
    raw AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT token, count(*) AS df FROM tf GROUP BY 1), st),
    idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def _bm25_sql(queries: str, k: int) -> str:
    return _INDEX + f""",
    q AS (SELECT query, token, count(*) AS times FROM (SELECT query, unnest(string_split_regex(lower(text), {_WS})) AS token FROM ({queries})) WHERE token <> '' GROUP BY ALL),
    bs AS (SELECT query, unit, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score FROM q JOIN idf USING (token) JOIN tf USING (token) JOIN dl USING (unit), st GROUP BY ALL),
    bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, unit) AS rank FROM bs WHERE score > 0) WHERE rank <= {k})"""


def _dense_sql(queries: str, k: int, extra: str = "true") -> str:
    return f"""
    dn AS (SELECT * FROM (SELECT query, unit, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, unit) AS rank
        FROM (SELECT q.query, e.vec_id AS unit, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, ({queries}) q WHERE {extra})) WHERE rank <= {k})"""


_ITEMS_SQL = "SELECT item_id AS query, text FROM benchmark"
_ITEM_VECTORS_SQL = "SELECT b.item_id AS query, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id"
_PROBES_SQL = "SELECT vec_id AS query, embedding FROM embeddings WHERE vec_id % 50 = 0"
_RANKS_SQL = f"WITH {_bm25_sql(_ITEMS_SQL, CANDIDATES)}, {_dense_sql(_ITEM_VECTORS_SQL, CANDIDATES)}"
_FUSED_SQL = f"""{_RANKS_SQL},
    r AS (SELECT query, unit, 'dense' AS signal, rank FROM dn UNION ALL SELECT query, unit, 'bm25', rank FROM bm),
    f AS (SELECT query, unit, sum(CASE signal WHEN 'dense' THEN 1.0 ELSE 0.7 END / (60 + rank)) AS score, max(CASE WHEN signal = 'dense' THEN rank END) AS dense_rank, max(CASE WHEN signal = 'bm25' THEN rank END) AS bm25_rank FROM r GROUP BY ALL),
    fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, unit) AS rank FROM f) WHERE rank <= {K})"""


# --- lexical -------------------------------------------------------------------------------------------------------
_SAVED: dict[tuple[str, str], segments.SegmentedIndex] = {}


def _index(spark: SparkSession, sf: str) -> segments.SegmentedIndex:
    """The saved index of all documents. The first query of a session over a folder makes it, as `Engine.index` does."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SAVED or not _SAVED[key].exists():
        index = segments.SegmentedIndex(spark, Workspace(spark, "documents-bm25").path("index"))
        index.rebuild(_t(spark, sf, "documents"), "doc_id", None)
        _SAVED[key] = index
    return _SAVED[key]


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"SELECT unit AS doc_id, count(*) AS n_words, count(DISTINCT token) AS n_distinct FROM ({_WORDS}) WHERE token <> '' GROUP BY 1")
def tokenize_stats(spark, sf):
    words = F.col("words")
    docs = _t(spark, sf, "documents").select("doc_id", tx.tokenize(F.col("text")).alias("words")).where(F.size(words) > 0)
    return docs.select("doc_id", F.size(words).cast("long").alias("n_words"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


@query(f"""WITH d AS (SELECT doc_id, list_distinct(string_split_regex(lower(text), {_WS})) AS words FROM documents),
    df AS MATERIALIZED (SELECT token, count(*) AS df FROM (SELECT unnest(words) AS token FROM d) WHERE token <> '' GROUP BY 1),
    raw AS MATERIALIZED (SELECT token, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS raw FROM df)
    SELECT token, df, round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END, 6) AS idf FROM raw""")
def token_weights(spark, sf):
    return _index(spark, sf).weights().select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_bm25_sql(f"SELECT 0 AS query, '{QUERY}' AS text", 20)} SELECT unit AS doc_id, round(score, 6) AS score, rank::INT AS rank, replace(left(text, 200), chr(10), ' ') AS preview FROM bm JOIN documents d ON d.doc_id = bm.unit")
def bm25_topk(spark, sf):
    docs = _t(spark, sf, "documents")
    found = _index(spark, sf).search(_rows(spark, [(0, QUERY)], "query_id int, query string"), 20)
    return fusion.hydrate(found, docs.select(F.col("doc_id").alias("unit"), tx.preview(F.col("text")).alias("preview")), "preview").select(F.col("unit").alias("doc_id"), F.round("score", 6).alias("score"), "rank", "preview")


@query(f"WITH {_bm25_sql(_ITEMS_SQL, K)} SELECT query, unit AS doc_id, round(score, 6) AS score, rank::INT AS rank FROM bm")
def bm25_batch_queries(spark, sf):
    return _index(spark, sf).search(_items(spark, sf), K).select("query", F.col("unit").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"""WITH q AS (SELECT DISTINCT query, word FROM (SELECT item_id AS query, unnest(string_split_regex(lower(text), {_WS})) AS word FROM benchmark) WHERE word <> ''),
    w AS (SELECT DISTINCT word FROM q), hit AS (SELECT doc_id, word FROM documents, w WHERE contains(lower(text), word)), m AS (SELECT query, doc_id, count(*) AS matched FROM hit JOIN q USING (word) GROUP BY ALL)
    SELECT query, doc_id AS source, matched, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY matched DESC, doc_id) AS rank FROM m) WHERE rank <= {K}""")
def grep_baseline(spark, sf):
    return evaluate.grep(_t(spark, sf, "documents"), _t(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text"), K, "doc_id")


@query("SELECT doc_id, left(text, 200) = text AS whole, replace(left(text, 200), chr(10), ' ') AS preview FROM documents")
def preview_projection(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", (F.substring("text", 1, 200) == F.col("text")).alias("whole"), tx.preview(F.col("text")).alias("preview"))


# --- dense ---------------------------------------------------------------------------------------------------------
def _dense(spark, sf, k, exclude_self=False):
    vectors = _t(spark, sf, "embeddings")
    return dense.dense_search(vectors, vectors.where("vec_id % 50 = 0"), k, "vec_id", query_id_col="vec_id", exclude_self=exclude_self)


@query(f"WITH {_dense_sql('SELECT vec_id AS query, embedding FROM embeddings WHERE vec_id = 0', 20)} SELECT unit AS vec_id, round(score, 6) AS score, rank::INT AS rank FROM dn")
def dense_topk(spark, sf):
    vectors = _t(spark, sf, "embeddings")
    return dense.dense_search(vectors, vectors.where("vec_id = 0"), 20, "vec_id", query_id_col="vec_id").select(F.col("unit").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_dense_sql(_PROBES_SQL, K, 'q.query <> e.vec_id')} SELECT query, unit AS vec_id, round(score, 6) AS score, rank::INT AS rank FROM dn")
def dense_batch(spark, sf):
    return _dense(spark, sf, K, True).select("query", F.col("unit").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


_ANN: dict[tuple[str, str], ann.AnnIndex] = {}


def _ann(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Approximate neighbours of the probes, from the saved index of all vectors, made by a session's first query."""
    key, vectors = (spark.sparkContext.applicationId, sf), _t(spark, sf, "embeddings")
    if key not in _ANN or not _ANN[key].exists():
        index = ann.AnnIndex(spark, Workspace(spark, "embeddings-ann").path("index"))
        index.build(vectors, "vec_id")
        _ANN[key] = index
    return _ANN[key].search(vectors.where("vec_id % 50 = 0"), vectors, k, "vec_id", query_id_col="vec_id", exclude_self=True)


@query()
def ann_batch(spark, sf):
    return _ann(spark, sf, K).select("query", F.col("unit").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("SELECT count(*) AS n, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0")
def ann_recall(spark, sf):
    """Recall at 10 against the exact search over all rows: at least 0.9."""
    return ann.recall(_ann(spark, sf, K), _dense(spark, sf, K, True)).select("n", (F.col("recall") >= 0.9).alias("recall_reached"))


@query(f"""WITH {_bm25_sql(_ITEMS_SQL, K)} SELECT count(DISTINCT query) AS n, true AS fewer_read, count(*) AS found FROM bm""")
def bm25_skipped_ranges(spark, sf):
    """Block bounds over all items: some blocks are skipped, and all of the k best are found."""
    index, items = _index(spark, sf), _items(spark, sf)
    read = index.blocks(items, K).agg((F.sum(F.when(F.col("kept"), 0).otherwise(F.col("blocks"))) > 0).alias("fewer_read"))
    return index.search(items, K).agg(F.countDistinct("query").alias("n"), F.count(F.lit(1)).alias("found")).join(read).select("n", "fewer_read", "found")


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_expression(spark, sf):
    v = _t(spark, sf, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(dense.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


# --- fusion --------------------------------------------------------------------------------------------------------
def _ranks(spark, sf):
    vectors = _t(spark, sf, "embeddings")
    asked = _t(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id")).join(vectors.select("vec_id", "embedding"), "vec_id")
    found = dense.dense_search(vectors, asked, CANDIDATES, "vec_id", query_id_col="vec_id")
    return fusion.signals(dense=found, bm25=_index(spark, sf).search(_items(spark, sf), CANDIDATES))


def _fused(spark, sf):
    return fusion.fuse(_ranks(spark, sf), WEIGHTS, K)


@query(f"{_FUSED_SQL} SELECT query, unit, round(score, 6) AS score, rank::INT AS rank FROM fused")
def rrf_hybrid(spark, sf):
    return _fused(spark, sf).select("query", "unit", F.round("score", 6).alias("score"), "rank")


@query(f"{_FUSED_SQL} SELECT query, unit, dense_rank::INT AS dense_rank, bm25_rank::INT AS bm25_rank FROM fused")
def rrf_rank_provenance(spark, sf):
    return _fused(spark, sf).select("query", "unit", "dense_rank", "bm25_rank")


_GOLD_SQL = "gold AS (SELECT b.item_id AS query, d.doc_id AS unit FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _gold(spark, sf):
    items = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("pattern"))
    found = evaluate.containing(_t(spark, sf, "documents"), items, "doc_id")
    return found.join(items, "pattern").groupBy("query").agg(F.collect_set("source").alias("expected"))


_SETTINGS = [(f"b{b}", s, w) for b in (0.0, 0.3, 0.5, 0.7, 1.0) for s, w in (("dense", 1.0), ("bm25", b))]


@query(f"""{_RANKS_SQL}, {_GOLD_SQL}, s(setting, signal, weight) AS (SELECT * FROM {fx.values(_SETTINGS, 'setting', 'signal', 'weight')}),
    r AS (SELECT query, unit, 'dense' AS signal, rank FROM dn UNION ALL SELECT query, unit, 'bm25', rank FROM bm),
    f AS (SELECT setting, query, unit, sum(weight / (60 + rank)) AS score FROM r JOIN s USING (signal) GROUP BY ALL),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY setting, query ORDER BY round(score, 9) DESC, unit) AS rank FROM f) WHERE rank <= {K}),
    h AS (SELECT t.setting, g.query, (SELECT min(k.rank) FROM k JOIN gold USING (query, unit) WHERE k.setting = t.setting AND k.query = g.query) AS rank FROM (SELECT DISTINCT setting FROM s) t, (SELECT DISTINCT query FROM gold) g)
    SELECT setting, count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_k, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM h GROUP BY 1""")
def weight_sweep(spark, sf):
    settings = _rows(spark, _SETTINGS, "setting string, signal string, weight double")
    swept = fusion.sweep(_ranks(spark, sf), settings, K)
    gold = _gold(spark, sf).join(F.broadcast(settings.select("setting").distinct()))
    hits = gold.select("setting", "query", F.explode("expected").alias("unit")).join(swept, ["setting", "query", "unit"]).groupBy("setting", "query").agg(F.min("rank").alias("rank"))
    out = evaluate.metrics(gold.join(hits, ["setting", "query"], "left"), "setting")
    return out.select("setting", "n", F.round("hit_at_k", 6).alias("hit_at_k"), F.round("mrr", 6).alias("mrr"))


_CATEGORY_SQL = "CASE query % 4 WHEN 0 THEN 'keyword' WHEN 1 THEN 'paraphrase' WHEN 2 THEN 'mixed' ELSE 'graph' END"


def _hits(spark, sf):
    gold = _gold(spark, sf).withColumn("category", F.expr("CASE query % 4 WHEN 0 THEN 'keyword' WHEN 1 THEN 'paraphrase' WHEN 2 THEN 'mixed' ELSE 'graph' END"))
    ranked = evaluate.distinct_sources(_fused(spark, sf).withColumn("source", F.col("unit")))
    return evaluate.first_hits(gold, ranked)


_HITS_SQL = f"{_FUSED_SQL}, {_GOLD_SQL}, h AS (SELECT g.query, min(fused.rank) AS rank FROM gold g LEFT JOIN fused ON fused.query = g.query AND fused.unit = g.unit GROUP BY 1)"


@query(f"{_HITS_SQL} SELECT query, {_CATEGORY_SQL} AS category, rank::INT AS rank FROM h")
def first_hit_rank(spark, sf):
    return _hits(spark, sf).select("query", "category", "rank")


@query(f"""{_HITS_SQL}, s AS (SELECT *, unnest(['all', CASE WHEN query % 4 = 3 THEN 'graph' ELSE 'base' END]) AS segment FROM h)
    SELECT 'hybrid' AS method, segment, count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_k, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM s GROUP BY segment""")
def hit_mrr_by_category(spark, sf):
    out = evaluate.segments(_hits(spark, sf).withColumn("method", F.lit("hybrid")))
    return out.select("method", "segment", "n", F.round("hit_at_k", 6).alias("hit_at_k"), F.round("mrr", 6).alias("mrr"))


@query(f"""{_HITS_SQL}, t AS (SELECT CASE WHEN rank <= 10 THEN rank END AS rank FROM h)
    SELECT count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_at_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr_at_10 FROM t""")
def benchmark_metrics(spark, sf):
    return evaluate.truncated_metrics(_hits(spark, sf)).select("n", *(F.round(c, 6).alias(c) for c in ("hit_at_5", "hit_at_10", "mrr_at_10")))


@query("""SELECT l_returnflag AS agent, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS failures, round(avg(CASE WHEN l_linestatus <> 'O' AND l_linenumber <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_5, round(avg(CASE WHEN l_linestatus <> 'O' THEN 1.0 / l_linenumber ELSE 0 END), 6) AS mrr,
    round(avg(l_quantity) FILTER (l_linestatus <> 'O'), 4) AS latency_mean, max(l_quantity) FILTER (l_linestatus <> 'O') AS latency_max, round(avg(l_partkey) FILTER (l_linestatus <> 'O'), 4) AS tokens_mean, (sum(l_partkey) FILTER (l_linestatus <> 'O'))::BIGINT AS tokens_total FROM lineitem GROUP BY 1""")
def agent_benchmark(spark, sf):
    """The aggregates of an agent benchmark; line items stand for its runs."""
    runs = _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("agent"), F.col("l_linenumber").alias("rank"), (F.col("l_linestatus") == "O").alias("failed"), F.col("l_quantity").alias("latency"), F.col("l_partkey").alias("tokens"))
    out = evaluate.agent_metrics(runs, "agent")
    return out.withColumns({c: F.round(c, d) for c, d in (("hit_at_5", 6), ("mrr", 6), ("latency_mean", 4), ("tokens_mean", 4))})


@query(f"""WITH {_dense_sql(_PROBES_SQL, K, 'q.query <> e.vec_id')}, h AS (SELECT p.vec_id AS query, (SELECT min(rank) FROM dn JOIN embeddings e ON e.vec_id = dn.unit WHERE dn.query = p.vec_id AND e.label = p.label) AS rank FROM embeddings p WHERE p.vec_id % 50 = 0)
    SELECT count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_k, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM h""")
def neighbour_label_accuracy(spark, sf):
    v = _t(spark, sf, "embeddings")
    found = _dense(spark, sf, K, True).join(v.select(F.col("vec_id").alias("unit"), F.col("label").alias("own")), "unit")
    probes = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "label")
    hits = found.join(probes, "query").where("own = label").groupBy("query").agg(F.min("rank").alias("rank"))
    return evaluate.metrics(probes.join(hits, "query", "left")).select("n", F.round("hit_at_k", 6).alias("hit_at_k"), F.round("mrr", 6).alias("mrr"))


# --- answers -------------------------------------------------------------------------------------------------------
@query(f"WITH {_dense_sql(_PROBES_SQL, K, 'q.query <> e.vec_id')} SELECT query, round(max(score), 6) AS top_similarity, max(score) < 0.6 AS no_evidence FROM dn GROUP BY 1")
def relevance_gate(spark, sf):
    found = _dense(spark, sf, K, True)
    asked = _t(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"))
    return answer.gate(asked, found, dense.top_similarity(found), 0.6).select("query", F.round("top_similarity", 6).alias("top_similarity"), "no_evidence")


def _found(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("unit"), "source", "text", F.lit("").alias("kind"), F.lit(None).cast("int").alias("community_id"))
    fused = Workspace(spark, "found").table(_fused(spark, sf), "fused")  # K rows a question, read more than once
    return F.broadcast(fused).join(docs, "unit")


@query(f"""{_FUSED_SQL}, s AS (SELECT query, source AS label, max(score) AS score, min(rank) AS first FROM fused JOIN documents d ON d.doc_id = fused.unit GROUP BY ALL)
    SELECT query, label, round(score, 6) AS score, (row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, first, label))::INT AS rank FROM s""")
def source_rollup(spark, sf):
    return answer.source_rollup(_found(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"{_FUSED_SQL} SELECT query, string_agg('[' || source || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM fused JOIN documents d ON d.doc_id = fused.unit WHERE rank <= 3 GROUP BY 1")
def context_assembly(spark, sf):
    return answer.contexts(_found(spark, sf).where("rank <= 3"))


@query()
def answer_batch(spark, sf):
    asked = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")
    found = _found(spark, sf)
    top = found.groupBy("query").agg(F.max("score").alias("top_similarity"))
    return answer.answers(asked, found.where("rank <= 5"), top, extractive_generator(), threshold=0.0)


@query()
def agentic_bounded(spark, sf):
    index = _index(spark, sf)
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("unit"), "text")

    def retrieve(q: str) -> str:
        found = index.search(_rows(spark, [(0, q)], "query_id int, query string"), 3)
        return "\n\n".join(r["text"] for r in F.broadcast(found).join(docs, "unit").orderBy("rank").collect())

    states = [answer.agentic(q, retrieve, extractive_generator()) for q in (QUERY, "zzzz qqqq")]
    return _rows(spark, [(s.question, s.iterations, len(s.rewrites), s.max_iterations_hit, s.answer) for s in states], "question string, iterations int, rewrites int, max_iterations_hit boolean, answer string")


@query()
def exhaustive_overview(spark, sf):
    summaries = _t(spark, sf, "documents").groupBy(F.regexp_extract("source", "(\\d+)", 1).cast("int").alias("community_id")).agg(F.min_by("text", "doc_id").alias("text"))
    out = answer.exhaustive(QUERY, summaries, extractive_generator())
    return _rows(spark, [(out["total"], out["skipped"], out["failed"], len(out["partials"]), out["answer"])], "total int, skipped int, failed int, relevant int, answer string")


@query()
def distill_note(spark, sf):
    topics = _items(spark, sf).select(F.col("query_id").alias("query"), F.col("query").alias("topic"), F.lit("2024-01-01").alias("date"))
    titles = _t(spark, sf, "documents").select(F.col("source").alias("title")).distinct()
    return answer.distill(topics, _found(spark, sf), titles, extractive_generator())


@query()
def search_tool_response(spark, sf):
    docs = _t(spark, sf, "documents")
    found = _index(spark, sf).search(_rows(spark, [(0, QUERY)], "query_id int, query string"), 5)
    found = F.broadcast(found).join(docs.select(F.col("doc_id").alias("unit"), "source", F.lit("").alias("header_path"), tx.preview(F.col("text")).alias("preview")), "unit")
    return answer.search_response(QUERY, found.withColumn("dense_rank", F.lit(None).cast("int")).withColumn("bm25_rank", F.col("rank")), 5)


# --- notes ---------------------------------------------------------------------------------------------------------
@query("SELECT d.doc_id, coalesce(l.quality = 1 AND l.toxic = 0, false) AS public FROM documents d LEFT JOIN labels l USING (doc_id)")
def public_filter(spark, sf):
    labels = _t(spark, sf, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("string").alias("flag"))
    return _t(spark, sf, "documents").join(labels, "doc_id", "left").select("doc_id", tx.is_public(F.col("flag")).alias("public"))


@query(f"SELECT raw, coalesce(lower(trim(raw, {_TRIM})) = 'true', false) AS public FROM {fx.values(fx.PUBLIC, 'raw')}")
def public_flag(spark, sf):
    return _rows(spark, fx.PUBLIC, "raw string").select("raw", tx.is_public(F.col("raw")).alias("public"))


def _norm_sql(x: str) -> str:
    return f"lower(trim(regexp_replace(trim(list_last(string_split(replace(split_part(split_part({x}, '|', 1), '#', 1), chr(92), '/'), '/')), {_TRIM}), '(?i)\\.md$', ''), {_TRIM}))"


@query(f"SELECT raw, {_norm_sql('raw')} AS target FROM {fx.values(fx.LINKS, 'raw')}")
def wikilink_norm(spark, sf):
    return _rows(spark, fx.LINKS, "raw string").select("raw", tx.normalize_link(F.col("raw")).alias("target"))


def _entity_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(trim({x}, {_TRIM})), {_WS}, ' ', 'g'), '.,;:!?''\"()[]{{}}')"


@query(f"SELECT raw, {_entity_sql('raw')} AS name FROM {fx.values(fx.NAMES, 'raw')}")
def entity_norm(spark, sf):
    return _rows(spark, fx.NAMES, "raw string").select("raw", tx.normalize_entity(F.col("raw")).alias("name"))


@query(rf"""SELECT raw, CASE WHEN s = '' THEN 'wiki-note' ELSE s END AS slug FROM (SELECT raw, trim(regexp_replace(regexp_replace(trim(raw, {_TRIM}), '[\\/:*?"<>|]', '', 'g'), {_WS}, '-', 'g'), '-') AS s FROM {fx.values(fx.TOPICS, 'raw')})""")
def slugify(spark, sf):
    return _rows(spark, fx.TOPICS, "raw string").select("raw", tx.slugify(F.col("raw")).alias("slug"))


@query(f"SELECT h1, h2, h3, concat_ws(' > ', nullif(h1, ''), nullif(h2, ''), nullif(h3, '')) AS path FROM {fx.values(fx.HEADERS, 'h1', 'h2', 'h3')}")
def header_path(spark, sf):
    return _rows(spark, fx.HEADERS, "h1 string, h2 string, h3 string").select("*", tx.header_path(F.col("h1"), F.col("h2"), F.col("h3")).alias("path"))


@query()
def frontmatter_fields(spark, sf):
    return vault.parse_notes(_rows(spark, fx.RAW_NOTES, "source string, raw string"))


@query()
def chunk_notes(spark, sf):
    return chunking.chunk_notes(vault.parse_notes(_rows(spark, fx.RAW_NOTES, "source string, raw string")))


@query()
def chunk_documents(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source"), F.col("text").alias("body"))
    return chunking.chunk_notes(docs).select("unit_id", "source", "chunk_index", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha"))


# --- graph ---------------------------------------------------------------------------------------------------------
def _notes(spark):
    return _rows(spark, fx.NOTES, "source string, stem string, node string, body string, related array<string>, tags array<string>")


_BACKBONE_SQL = f"""notes AS (SELECT * FROM {fx.values(fx.NOTES, *fx.NOTE_COLUMNS)}),
    names AS (SELECT name, arg_min(target, o) AS target FROM (SELECT lower(stem) AS name, min(source) AS target, 0 AS o FROM notes GROUP BY 1 UNION ALL SELECT lower(trim(node)), min(source), 1 FROM notes WHERE node <> '' GROUP BY 1) GROUP BY 1),
    links AS (SELECT source, {_norm_sql('l')} AS name FROM (SELECT source, unnest(regexp_extract_all(body, '\\[\\[([^\\]]+?)\\]\\]', 1)) AS l FROM notes)),
    e1 AS (SELECT least(source, target) AS src, greatest(source, target) AS dst, count(*)::DOUBLE AS weight, 'links_to' AS kind, 0 AS o FROM links JOIN names USING (name) WHERE source <> target GROUP BY 1, 2),
    rel AS (SELECT source, coalesce((SELECT target FROM names WHERE name = lower(trim(r, {_TRIM}))), (SELECT target FROM names WHERE name = {_norm_sql('r')})) AS target FROM (SELECT source, unnest(related) AS r FROM notes)),
    e2 AS (SELECT DISTINCT least(source, target) AS src, greatest(source, target) AS dst, 1.0::DOUBLE AS weight, 'related' AS kind, 1 AS o FROM rel WHERE target IS NOT NULL AND source <> target),
    tags AS (SELECT DISTINCT source, unnest(tags) AS tag FROM notes),
    e3 AS (SELECT DISTINCT a.source AS src, b.source AS dst, 1.0::DOUBLE AS weight, 'tagged' AS kind, 2 AS o FROM tags a JOIN tags b ON a.tag = b.tag AND a.source < b.source),
    edges AS (SELECT src, dst, arg_min(kind, o) AS kind, arg_min(weight, o) AS weight FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3) GROUP BY 1, 2)"""


@query(f"WITH {_BACKBONE_SQL} SELECT src, dst, kind, weight FROM edges")
def backbone_edges(spark, sf):
    return graph.backbone(_notes(spark))[0].select("src", "dst", "kind", "weight")


@query(f"WITH {_BACKBONE_SQL} SELECT source, name FROM links WHERE name NOT IN (SELECT name FROM names)")
def unresolved_links(spark, sf):
    return graph.backbone(_notes(spark))[1].select("source", "name")


@query(f"WITH {_BACKBONE_SQL} SELECT source FROM notes WHERE source NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def isolated_notes(spark, sf):
    return graph.isolated(_notes(spark), graph.backbone(_notes(spark))[0], "source").select("source")


@query("SELECT a.n_name AS src, b.n_name AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def tag_pairs(spark, sf):
    return graph.tag_pairs(_t(spark, sf, "nation").select("n_name", F.array(F.col("n_regionkey").cast("string")).alias("tags")), "n_name", "tags")


def _document_tags(spark, sf) -> DataFrame:
    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source"), F.array("source", F.concat(F.lit("lang/"), "lang")).alias("tags"))
    return graph.tag_members(docs)


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest([source, 'lang/' || lang]) AS tag FROM documents), p AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b USING (tag) WHERE a.doc_id <> b.doc_id),
    one AS (SELECT a AS query, b AS node, 2.2 AS score FROM p WHERE a % 50 = 0), two AS (SELECT DISTINCT query, b AS node, 1.4 AS score FROM one JOIN p ON p.a = one.node)
    SELECT query::VARCHAR AS query, node::VARCHAR AS node, round(max(score), 6)::DOUBLE AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE query <> node GROUP BY ALL""")
def tag_proximity(spark, sf):
    """Documents near every fiftieth one through what they share: source and language are tags. The SQL makes the pairs."""
    work = Workspace(spark, "tag-proximity")
    tags = work.table(_document_tags(spark, sf), "tags")
    seeds = tags.where("cast(node as long) % 50 = 0").select(F.col("node").alias("query"), "node").distinct()
    no_edges = _rows(spark, [], "src string, dst string, kind string, weight double")
    return graph.proximity(seeds, no_edges, 2, work, tags, 6)


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest([source, 'lang/' || lang]) AS tag FROM documents), e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.tag = b.tag AND a.doc_id < b.doc_id),
    w AS (SELECT d.source AS c, count(*) AS l FROM e JOIN documents d ON d.doc_id = a JOIN documents f ON f.doc_id = b WHERE d.source = f.source GROUP BY 1),
    g AS (SELECT d.source AS c, count(*) AS d FROM (SELECT a FROM e UNION ALL SELECT b FROM e) x(a) JOIN documents d ON d.doc_id = x.a GROUP BY 1)
    SELECT round(sum(coalesce(l, 0) / m - (d / (2.0 * m)) ** 2), 6) AS modularity FROM g LEFT JOIN w USING (c), (SELECT count(*)::DOUBLE AS m FROM e)""")
def tag_modularity(spark, sf):
    membership = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("node"), F.col("source").alias("community"))
    return graph.tag_modularity(_document_tags(spark, sf), membership).select(F.round("modularity", 6).alias("modularity"))


@query("SELECT page_id, target, count(*) AS weight FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) GROUP BY ALL")
def page_links(spark, sf):
    links = _t(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return links.groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("weight"))


_LINK_SQL = "e AS (SELECT doc_id::VARCHAR AS a, ((doc_id * 7 + 1) % n)::VARCHAR AS b, 'links_to' AS kind FROM documents, (SELECT count(*) AS n FROM documents) WHERE doc_id <> (doc_id * 7 + 1) % n UNION ALL SELECT doc_id::VARCHAR, ((doc_id * 3 + 2) % n)::VARCHAR, 'tagged' FROM documents, (SELECT count(*) AS n FROM documents) WHERE doc_id <> (doc_id * 3 + 2) % n)"


def _link_graph(spark, sf):
    """A synthetic graph over documents, the same in SQL."""
    docs = _t(spark, sf, "documents").select("doc_id")
    n = docs.count()
    parts = [docs.select(F.col("doc_id").cast("string").alias("src"), ((F.col("doc_id") * m + c) % n).cast("string").alias("dst"), F.lit(kind).alias("kind"), F.lit(1.0).alias("weight")) for m, c, kind in ((7, 1, "links_to"), (3, 2, "tagged"))]
    return parts[0].unionAll(parts[1]).where("src <> dst")


@query(f"WITH {_LINK_SQL} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1")
def degree_hubs(spark, sf):
    return graph.degrees(_link_graph(spark, sf)).select("node", "degree")


def _proximity_sql(hops: int) -> str:
    rounds = "".join(f", f{i + 1} AS (SELECT query, s.other AS node, \"left\" - 2 AS \"left\", max(score + gain) AS score FROM f{i} JOIN s ON s.node = f{i}.node WHERE \"left\" > 0 AND score + gain > -1 GROUP BY ALL)" for i in range(2 * hops))
    return f"""WITH {_LINK_SQL}, s AS (SELECT a AS node, b AS other, CASE kind WHEN 'links_to' THEN -0.5 ELSE -0.8 END AS gain FROM e UNION ALL SELECT b, a, CASE kind WHEN 'links_to' THEN -0.5 ELSE -0.8 END FROM e),
    f0 AS (SELECT doc_id AS query, doc_id::VARCHAR AS node, {2 * hops} AS "left", {hops + 1}.0 AS score FROM documents WHERE doc_id % 50 = 0){rounds}
    SELECT query, node, round(max(score), 6)::DOUBLE AS score FROM ({' UNION ALL '.join(f'SELECT * FROM f{i}' for i in range(2 * hops + 1))}) WHERE node <> query::VARCHAR GROUP BY 1, 2 HAVING max(score) > 0"""


@query(_proximity_sql(2))
def graph_proximity(spark, sf):
    seeds = _t(spark, sf, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), F.col("doc_id").cast("string").alias("node"))
    return graph.proximity(seeds, _link_graph(spark, sf), 2, Workspace(spark, "proximity")).select("query", "node", F.round("score", 6).alias("score"))


@query("""WITH o AS (SELECT 'o' || o_orderkey AS node, c_nationkey AS nation FROM orders JOIN customer ON c_custkey = o_custkey),
    m AS (SELECT node, nation FROM o UNION ALL SELECT DISTINCT 'n' || nation, nation FROM o) SELECT node, min(node) OVER (PARTITION BY nation) AS component FROM m""")
def connected_components(spark, sf):
    """Orders in a chain by customer, and each customer at a hub of its nation: long paths and hot nodes. Every chain hangs
    on its nation's hub, so the SQL needs no recursion; tests compare random graphs with a union-find."""
    orders = _t(spark, sf, "orders").select("o_custkey", "o_orderkey")
    chain = orders.withColumn("b", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("b is not null").select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("o"), "b").alias("b"))
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o")).join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    hubs = first.select(F.concat(F.lit("o"), "o").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b"))
    return components.connected_components(chain.unionAll(hubs), Workspace(spark, "components"))


@query(f"""WITH {_LINK_SQL}, c AS (SELECT a, b, a::BIGINT % 7 AS ca, b::BIGINT % 7 AS cb FROM e), m AS (SELECT count(*)::DOUBLE AS m FROM c),
    d AS (SELECT k, count(*) AS d FROM (SELECT ca AS k FROM c UNION ALL SELECT cb FROM c) GROUP BY 1), l AS (SELECT ca AS k, count(*) AS l FROM c WHERE ca = cb GROUP BY 1)
    SELECT round(sum(coalesce(l, 0) / m - (d / (2 * m)) * (d / (2 * m))), 6) AS modularity FROM d LEFT JOIN l USING (k), m""")
def modularity_of_partition(spark, sf):
    edges = _link_graph(spark, sf)
    nodes = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct()
    return graph.modularity(edges, nodes.withColumn("community", F.col("node").cast("long") % 7)).select(F.round("modularity", 6).alias("modularity"))


@query()
def leiden_communities(spark, sf):
    orders = _t(spark, sf, "orders").select("o_custkey", "o_orderkey")
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pairs = [orders.withColumn("dst", F.lag("o_orderkey", n).over(by)).where("dst is not null").select(F.col("o_orderkey").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit(1.0).alias("weight")) for n in (1, 2)]
    return community.communities(pairs[0].unionAll(pairs[1]), Workspace(spark, "leiden"))


@query("""SELECT community_id, titles, note_count, sha256(array_to_string(titles, chr(9)) || chr(10)) AS member_hash
    FROM (SELECT doc_id % 50 AS community_id, list('doc' || doc_id ORDER BY 'doc' || doc_id) AS titles, count(*) AS note_count FROM documents GROUP BY 1)""")
def community_members(spark, sf):
    nodes = _t(spark, sf, "documents").select(F.lit("note").alias("kind"), F.concat(F.lit("doc"), F.col("doc_id")).alias("title"), F.lit(None).cast("string").alias("name"), (F.col("doc_id") % 50).alias("community_id"))
    return graph.community_members(nodes).drop("entities")


@query(f"""WITH x AS (SELECT * FROM {fx.values(fx.EXTRACTED, 'source', 'raw')}),
    m AS (SELECT least(source, id) AS src, greatest(source, id) AS dst, 'mentions' AS kind, count(*)::DOUBLE AS weight, NULL AS label FROM (SELECT source, 'entity::' || {_entity_sql('n')} AS id FROM (SELECT source, unnest((raw->'$.entities')::VARCHAR[]) AS n FROM x)) WHERE id <> 'entity::' GROUP BY 1, 2),
    r AS (SELECT source, i, {_entity_sql('t[1]')} AS one, t[2] AS label, {_entity_sql('t[3]')} AS two FROM (SELECT source, generate_subscripts(rs, 1) AS i, unnest(rs) AS t FROM (SELECT source, (raw->'$.relations')::VARCHAR[][] AS rs FROM x)) WHERE len(t) >= 3),
    e AS (SELECT 'entity::' || least(one, two) AS src, 'entity::' || greatest(one, two) AS dst, 'relates_to' AS kind, 1.0::DOUBLE AS weight, arg_min(label, (source, i)) AS label FROM r WHERE one <> '' AND two <> '' AND one <> two GROUP BY 1, 2)
    SELECT * FROM m UNION ALL SELECT * FROM e""")
def extraction_to_edges(spark, sf):
    return graph.entity_edges(_rows(spark, fx.EXTRACTED, "source string, raw string"))


# --- increments ----------------------------------------------------------------------------------------------------
@query("""SELECT o_orderkey::VARCHAR AS unit_id, o_custkey AS source, o_orderstatus AS text FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0)
    UNION ALL SELECT o_orderkey::VARCHAR, o_custkey, 'new' FROM orders WHERE o_orderkey % 50 = 0""")
def incremental_upsert(spark, sf):
    units = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("unit_id"), F.col("o_custkey").alias("source"), F.col("o_orderstatus").alias("text"))
    return store.upserted(units, units.where("cast(unit_id as long) % 50 = 0").withColumn("text", F.lit("new")))


@query("""SELECT 'doc' || doc_id AS source, sha256(CASE WHEN lang = 'de' THEN 'neu: ' || text ELSE text END) AS text_sha FROM documents
    WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
    UNION ALL SELECT 'page' || page_id, sha256(html) FROM pages""")
def layered_store(spark, sf):
    """The unit store after four changes, each a layer: all documents, new texts for the German ones, all pages, and toxic
    documents and those without a text removed."""
    docs, pages, labels = (_t(spark, sf, name) for name in ("documents", "pages", "labels"))
    source, name = F.concat(F.lit("doc"), F.col("doc_id")).alias("source"), F.concat(F.lit("page"), F.col("page_id"))
    units, kept = docs.select(source.alias("unit_id"), source, "text", "lang"), store.UnitStore(spark, Workspace(spark, "layered").root)
    kept.replace(units.drop("lang"))
    kept.upsert(units.where("lang = 'de'").drop("lang").withColumn("text", F.concat(F.lit("neu: "), "text")))
    kept.upsert(pages.select(name.alias("unit_id"), name.alias("source"), F.col("html").alias("text")))
    kept.upsert(units.drop("lang").limit(0), sources=labels.where("toxic = 1").select(source).union(units.where("text is null").select("source")))
    return kept.read("").select("source", F.sha2("text", 256).alias("text_sha"))


@query("SELECT doc_id, sha256(text || CASE WHEN doc_id % 10 = 0 THEN '!' ELSE '' END) AS content_sha FROM documents WHERE doc_id % 10 = 0 OR doc_id % 4 = 0")
def changed_only(spark, sf):
    docs = _t(spark, sf, "documents")
    old = docs.where("doc_id % 4 <> 0").select("doc_id", F.sha2("text", 256).alias("content_sha"))
    new = docs.select("doc_id", F.sha2(F.concat("text", F.when(F.col("doc_id") % 10 == 0, "!").otherwise("")), 256).alias("content_sha"))
    return store.changed(old, new, "doc_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark, sf):
    out = incremental.windowed_counts(_t(spark, sf, "events"), "ts", "1 hour", "10 minutes", "event_type")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def event_sessions(spark, sf):
    out = incremental.session_counts(_t(spark, sf, "events"), "ts", "30 minutes", "10 minutes", "user_id")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "finish")})


@query("""SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE FOR i IN range(4)]) AS start FROM events) GROUP BY ALL""")
def sliding_event_counts(spark, sf):
    out = incremental.windowed_counts(_t(spark, sf, "events"), "ts", "1 hour", "10 minutes", "event_type", slide="15 minutes")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def question_answer_turns(spark, sf):
    c = _t(spark, sf, "conversations")
    told = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.where("role = 'user'").join(told, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("question"), "answer")
