"""From ranked units to answers: gate, sources, context, generation, and the multi-step forms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import compose_note, display_label, is_marker, link_list, slugify
from fathom.providers import IRRELEVANT, NO_EVIDENCE, Generator, generate_column

NO_EVIDENCE_TEXT = "No evidence for an answer was found in the notes."


def gate(queries: DataFrame, found: DataFrame, top: DataFrame, threshold: float = 0.48) -> DataFrame:
    """queries (query, ...) with top_similarity and no_evidence: nothing was found, or the best similarity among notes
    is under the threshold. A query whose similarity is unknown passes."""
    some = found.select("query").distinct().withColumn("_found", F.lit(True))
    joined = queries.join(top, "query", "left").join(some, "query", "left")
    return joined.withColumn("no_evidence", F.col("_found").isNull() | F.coalesce(F.col("top_similarity") < threshold, F.lit(False))).drop("_found")


def source_rollup(found: DataFrame) -> DataFrame:
    """(query, label, score, rank): each source with its best score; ties by the first place, then by name."""
    best = found.groupBy("query", display_label(F.col("kind"), F.col("source"), F.col("community_id")).alias("label")).agg(F.max("score").alias("score"), F.min("rank").alias("_first"))
    order = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "_first", "label")
    return best.withColumn("rank", F.row_number().over(order)).drop("_first")


def contexts(found: DataFrame) -> DataFrame:
    """(query, context): labelled texts of the found units, in rank order, with a blank line between."""
    label = display_label(F.col("kind"), F.col("source"), F.col("community_id"))
    entry = F.struct("rank", F.concat(F.lit("["), label, F.lit("] "), F.col("text")).alias("line"))
    return found.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["line"]), "\n\n").alias("context"))


def _prompt(task: str) -> F.Column:
    return F.concat(F.lit(f"{task}\n"), F.col("text"), F.lit("\n\n"), F.coalesce("context", F.lit("")))


def answers(queries: DataFrame, found: DataFrame, top: DataFrame, generator: Generator, threshold: float = 0.48) -> DataFrame:
    """(query, answer, no_evidence, error) of queries (query, text). Gated queries never reach the generator."""
    ready = gate(queries.select("query", "text"), found, top, threshold).join(contexts(found), "query", "left")
    made = generate_column(ready.select("query", F.when(~F.col("no_evidence"), _prompt("ANSWER")).alias("prompt")), generator)
    none = F.col("prompt").isNull() | F.coalesce(is_marker(F.col("answer"), NO_EVIDENCE), F.lit(False))
    return made.select("query", F.when(none, NO_EVIDENCE_TEXT).otherwise(F.col("answer")).alias("answer"), none.alias("no_evidence"), "error")


def exhaustive(question: str, summaries: DataFrame, generator: Generator) -> dict:
    """Ask every community summary (community_id, text), drop the irrelevant, and combine the rest in one last call.

    Returns answer, partials and counts. If the last call fails, the partial answers are listed instead.
    """
    asked = summaries.select("community_id", F.col("text").alias("context"), F.lit(question).alias("text")).withColumn("prompt", _prompt("MAP"))
    told = generate_column(asked.select("community_id", "prompt"), generator).orderBy("community_id").collect()
    failed = [r for r in told if r["error"]]
    partials = [(r["community_id"], r["answer"]) for r in told if not r["error"] and not r["answer"].strip().startswith(IRRELEVANT)]
    counts = {"total": len(told), "failed": len(failed), "skipped": len(told) - len(failed) - len(partials)}
    if not partials:
        return counts | {"answer": NO_EVIDENCE_TEXT, "partials": []}
    joined = "\n\n".join(f"[community {c}] {t}" for c, t in partials)
    try:
        answer = generator(f"REDUCE\n{question}\n\n{joined}")
    except Exception:
        answer = joined
    return counts | {"answer": answer, "partials": partials}


@dataclass
class AgentState:
    question: str
    query: str
    iterations: int = 0
    rewrites: list[str] = field(default_factory=list)
    sufficient: bool = False
    context: str = ""
    answer: str = ""
    max_iterations_hit: bool = False


def agentic(question: str, retrieve: Callable[[str], str], generator: Generator, max_iterations: int = 2) -> AgentState:
    """Retrieve, grade, rewrite from the original question while the grade is bad, then answer. At most max_iterations
    retrievals; a grade that could change nothing is not asked for."""
    limit = max(1, max_iterations)
    state = AgentState(question, question)
    while True:
        state.context = retrieve(state.query)
        state.iterations += 1
        if state.iterations >= limit:
            break
        state.sufficient = bool(state.context) and "yes" in generator(f"GRADE\n{question}\n\n{state.context}").lower()
        if state.sufficient:
            break
        state.query = generator(f"REWRITE\n{question}\n\n").strip() or question
        state.rewrites.append(state.query)
    state.max_iterations_hit = bool(state.rewrites) and state.iterations >= limit and not state.sufficient
    told = generator(f"ANSWER\n{question}\n\n{state.context}") if state.context else NO_EVIDENCE
    state.answer = NO_EVIDENCE_TEXT if told.strip().startswith(NO_EVIDENCE) else told
    return state


def select_links(proposed: DataFrame, titles: DataFrame) -> DataFrame:
    """(topic, links): proposed names (topic, raw) that are titles, not the topic itself, once each, in order."""
    names = proposed.select("topic", F.posexplode(link_list(F.col("raw"))).alias("place", "name")).where("name <> lower(topic)")
    real = names.groupBy("topic", "name").agg(F.min("place").alias("place")).join(titles.select(F.lower("title").alias("name"), F.col("title")).groupBy("name").agg(F.min("title").alias("title")), "name")
    return real.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda e: e["title"]).alias("links"))


def distill(topics: DataFrame, found: DataFrame, titles: DataFrame, generator: Generator, evidence: int = 6) -> DataFrame:
    """(topic, filename, note, links, no_evidence) of topics (query, topic, date): notes from the best `evidence` units.
    Topics without evidence get no note."""
    used = found.where(F.col("rank") <= evidence)
    asked = topics.join(contexts(used), "query", "left").withColumn("text", F.col("topic")).withColumn("prompt", _prompt("ANSWER"))
    body = generate_column(asked.select("query", "topic", "date", "prompt"), generator)
    proposed = used.where("kind <> 'community_summary'").join(topics, "query").groupBy("topic").agg(F.array_join(F.array_sort(F.collect_set(F.regexp_replace("source", "(?i)\\.md$", ""))), ",").alias("raw"))
    linked = body.join(select_links(proposed, titles), "topic", "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))
    none = F.coalesce(is_marker(F.col("answer"), NO_EVIDENCE), F.lit(True))
    note = F.when(~none, compose_note(F.col("topic"), F.col("answer"), F.col("links"), F.col("date")))
    return linked.select("topic", F.concat(slugify(F.col("topic")), F.lit(".md")).alias("filename"), note.alias("note"), "links", none.alias("no_evidence"))


def search_response(query: str, found: DataFrame, k: int) -> DataFrame:
    """One row (response): the JSON of a search tool."""
    entry = F.struct("rank", "source", "header_path", "preview", F.round("score", 6).alias("rrf_score"), "dense_rank", "bm25_rank")
    rows = found.agg(F.array_sort(F.collect_list(entry)).alias("results"))
    return rows.select(F.to_json(F.struct(F.lit(query).alias("query"), F.lit(k).alias("k"), F.size("results").alias("total"), "results")).alias("response"))
