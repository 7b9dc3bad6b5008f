"""Okapi BM25: an index of DataFrames, and search for a whole table of queries at once.

The index here is a plan over the units; `segments` has the saved one. A search looks at the asked words first: only their
postings leave the scan, and the mean weight of all words, which takes the whole vocabulary, is worked out when a search
asks for a word that more than half of the units have.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import tokenize
from fathom.storage import Workspace

Tokenizer = Callable[[Column], Column]
TIE_DIGITS = 9
#: The most words that are named in a plan.
NAMED_WORDS = 5000


def _words(units: DataFrame, id_col: str, text_col: str, tokenizer: Tokenizer) -> DataFrame:
    """(unit, words, dl): null and blank texts have no words."""
    words = F.coalesce(tokenizer(F.col(text_col)), F.array().cast("array<string>"))
    return units.select(F.col(id_col).alias("unit"), words.alias("words")).withColumn("dl", F.size("words"))


@dataclass(frozen=True)
class Bm25Index:
    """Words of the units and the corpus numbers. k1, b and epsilon as in the common Okapi form: a negative weight becomes epsilon times the mean weight."""

    n_units: int
    mean_length: float
    words: DataFrame
    tokenizer: Tokenizer = field(default=tokenize)
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25

    @classmethod
    def build(cls, units: DataFrame, id_col: str = "unit_id", text_col: str = "text", tokenizer: Tokenizer = tokenize, **params: float) -> Bm25Index:
        words = _words(units, id_col, text_col, tokenizer)
        row = words.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).first()
        return cls(row["n"], row["mean"] or 0.0, words, tokenizer=tokenizer, **params)

    def postings(self, asked: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
        """(token, unit, tf, dl) of all words, or of the asked ones (token). Few are also given by name: only they leave the
        scan."""
        rows = self.words
        if names is not None:
            rows = rows.withColumn("words", F.filter("words", lambda w: w.isin(names))) if len(names) <= 50 else rows
        rows = rows.select("unit", "dl", F.explode("words").alias("token"))
        if asked is not None:
            rows = rows.join(F.broadcast(asked) if names is not None else asked, "token", "left_semi")
        return rows.groupBy("token", "unit").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))

    def _raw(self, df: DataFrame) -> DataFrame:
        return df.withColumn("raw", F.log(self.n_units - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))

    def _vocabulary(self) -> DataFrame:
        return self.words.select(F.explode(F.array_distinct("words")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    def _weighed(self, df: DataFrame, mean: float | None) -> DataFrame:
        floor = F.lit(None).cast("double") if mean is None else F.lit(self.epsilon * mean)
        return self._raw(df).select("token", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))

    def _mean(self) -> float | None:
        return self._raw(self._vocabulary()).agg(F.avg("raw")).first()[0]

    def weights(self) -> DataFrame:
        """(token, df, idf) of all words."""
        raw = self._raw(self._vocabulary())
        mean = F.broadcast(raw.agg(F.avg("raw").alias("mean")))
        return raw.join(mean).select("token", "df", F.when(F.col("raw") < 0, self.epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))

    def scores(self, queries: DataFrame, id_col: str = "query_id", query_col: str = "query") -> DataFrame:
        """(query, unit, score) for units that share a word with a query. A word that a query repeats counts again."""
        asked = queries.select(F.col(id_col).alias("query"), F.explode(self.tokenizer(F.col(query_col))).alias("token")).groupBy("query", "token").agg(F.count(F.lit(1)).alias("times"))
        tokens = asked.select("token").distinct()
        few = [r[0] for r in tokens.limit(NAMED_WORDS + 1).collect()]
        names = few if len(few) <= NAMED_WORDS else None
        found = self.postings(tokens, names)
        found = Workspace(queries.sparkSession, "bm25").table(found, "postings")  # read three times below
        df = found.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        mean = None
        if not df.where(F.col("df") > (self.n_units - 0.5) / 2).isEmpty():
            mean = self._mean()
        weighed = asked.join(self._weighed(df, mean), "token")
        tf = F.col("tf")
        norm = tf + self.k1 * (1 - self.b + self.b * F.col("dl") / F.lit(self.mean_length))
        found = found.join(weighed, "token")
        return found.groupBy("query", "unit").agg(F.sum(F.col("times") * F.col("idf") * tf * (self.k1 + 1) / norm).alias("score"))

    def search(self, queries: DataFrame, k: int, id_col: str = "query_id", query_col: str = "query", keep_zero: bool = False) -> DataFrame:
        """(query, unit, score, rank): the k best of each query, positive scores only; ties by unit."""
        scored = self.scores(queries, id_col, query_col)
        return top_k(scored if keep_zero else scored.where("score > 0"), k)


def top_k(scored: DataFrame, k: int, partition: str = "query", key: str = "unit") -> DataFrame:
    """The k best of each partition. Scores that agree to TIE_DIGITS are ties, so that the order of a sum does not
    decide, and go by key."""
    order = Window.partitionBy(partition).orderBy(F.round("score", TIE_DIGITS).desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
