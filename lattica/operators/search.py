"""Search by keywords (BM25), by vectors, and both."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cosine, words
from ..sources.scratch import fresh

K1, B = 1.5, 0.75
WEIGHTS = {"name_exact": 20.0, "name_substring": 10.0, "name_word": 5.0, "summary_word": 3.0, "value_exact": 8.0, "value_substring": 4.0, "type_boost": 2.0, "bm25": 5.0, "semantic": 20.0}
BOUNDS = (0.0, 100.0)


def equal_to(word: str) -> Callable[[Column], Column]:
    return lambda x: x == word


def containing(part: str) -> Callable[[Column], Column]:
    return lambda x: x.contains(part)


def bm25(docs: DataFrame, query: str, id_col: str, text_col: str, top: int | None = 10) -> DataFrame:
    """(id, score) of the best documents, or of all that have a word of the query.

    Texts are read once: each document's length and counts of the query's
    words, a few numbers, are written down, and document frequencies and
    scores come from those.  The query is a literal, so no index and no join
    over the corpus is needed.
    """
    terms = sorted(set(words_of(query)))
    if not terms:
        return docs.select(F.col(id_col), F.lit(0.0).alias("score")).limit(0)
    # Words are counted where they stand in the text, never laid out as arrays.
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    counts = docs.select(F.col(id_col).alias("id"), F.regexp_count(text, F.lit("[a-z0-9]+")).alias("dl"), *[F.when(text.contains(w), F.regexp_count(text, F.lit(f"(?<![a-z0-9]){w}(?![a-z0-9])"))).otherwise(0).alias(f"tf{i}") for i, w in enumerate(terms)])
    path = fresh(docs.sparkSession)
    counts.write.parquet(path)
    counts = docs.sparkSession.read.schema(counts.schema).parquet(path)
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hit = sum((F.col(f"tf{i}") for i in range(1, len(terms))), F.col("tf0")) > 0
    scored = counts.where(hit).crossJoin(F.broadcast(stats)).select(F.col("id").alias(id_col), F.round(score, 6).alias("score"))
    return scored if top is None else scored.orderBy(F.desc("score"), id_col).limit(top)


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def keyword_score(query: str, weights: dict[str, float] | None = None) -> Column:
    """Score of one column (name, type, summary, values array) for a query."""
    w = WEIGHTS | (weights or {})
    q, terms = query.lower(), words_of(query)
    name, summary = F.lower("name"), F.lower(F.coalesce("summary", F.lit("")))
    values = F.transform(F.coalesce("values", F.array().cast("array<string>")), F.lower)
    score = F.when(name == q, w["name_exact"]).when(name.contains(q), w["name_substring"]).otherwise(0.0)
    for t in terms:
        score = score + F.when(F.array_contains(words(F.col("name")), t), w["name_word"]).otherwise(0.0) + F.when(F.array_contains(words(summary), t), w["summary_word"]).otherwise(0.0)
        score = score + F.when(F.array_contains(values, t), w["value_exact"]).when(F.lit(len(t) >= 3) & F.exists(values, containing(t)), w["value_substring"]).otherwise(0.0)
    numeric = {"number", "amount", "count", "total", "average", "sum"} & set(terms)
    dates = {"date", "time", "when", "year", "month"} & set(terms)
    return score + F.when(F.lit(bool(numeric)) & F.col("type").isin("integer", "float"), w["type_boost"]).when(F.lit(bool(dates)) & (F.col("type") == "datetime"), w["type_boost"]).otherwise(0.0)


def search_columns(columns: DataFrame, query: str, top: int = 10, weights: dict[str, float] | None = None, vectors: DataFrame | None = None, query_vector: list[float] | None = None, semantic_weight: float = 0.0) -> DataFrame:
    """(name, score from 0 to 1) of the best columns; with vectors (name, vector) keyword and cosine scores are blended."""
    w = WEIGHTS | (weights or {})
    text = F.concat_ws(" ", "name", "summary", F.array_join(F.coalesce("values", F.array().cast("array<string>")), " "))
    ranked = bm25(columns.select("name", text.alias("text")), query, "name", "text", None).withColumnRenamed("score", "bm25")
    rows = columns.select("name", keyword_score(query, weights).alias("kw")).join(ranked, "name", "left").select("name", (F.col("kw") + w["bm25"] * F.coalesce("bm25", F.lit(0.0))).alias("score"))
    if vectors is not None and query_vector is not None:
        q = F.array(*[F.lit(float(x)) for x in query_vector])
        near = vectors.select("name", cosine(F.col("vector"), q).alias("cos"))
        rows = rows.join(near, "name", "left").select("name", ((1 - semantic_weight) * F.col("score") + semantic_weight * w["semantic"] * F.coalesce("cos", F.lit(0.0))).alias("score"))
    best = rows.agg(F.max("score").alias("best"))
    return rows.where("score > 0").crossJoin(F.broadcast(best)).select("name", F.round(F.col("score") / F.col("best"), 4).alias("score")).orderBy(F.desc("score"), "name").limit(top)


def tuned(changes: dict[str, float], *layers: dict[str, float]) -> dict[str, float]:
    """Defaults, then each layer, then the changes, held inside bounds; unknown names are refused."""
    out = dict(WEIGHTS)
    for layer in (*layers, changes):
        unknown = set(layer) - set(WEIGHTS)
        if unknown:
            raise ValueError(f"unknown weights {sorted(unknown)}")
        out |= {k: min(BOUNDS[1], max(BOUNDS[0], float(v))) for k, v in layer.items()}
    return out


def search_verdict(hits: int, names: list[str], query: str, semantic: bool = False, vectors: bool = True) -> dict:
    """ok, absent, or degraded where vectors were asked for and are not there (so nothing found proves nothing); names near the query where nothing was found."""
    state = "degraded" if semantic and not vectors else "ok" if hits else "absent"
    out = {"state": state, "channels": {"keywords": "ok", "vectors": ("ok" if vectors else "unavailable") if semantic else "off"}}
    if hits:
        return out
    terms = [t for t in words_of(query) if len(t) >= 3]
    near = [n for n in names if any(t in n.lower() for t in terms)] or difflib.get_close_matches(query, names, 5, 0.6)
    return out | ({"did_you_mean": near[:5]} if near else {})


def cosine_top(vectors: DataFrame, query: list[float], id_col: str, vector_col: str, top: int = 10) -> DataFrame:
    """The nearest vectors by cosine: one pass and a top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col), F.round(cosine(F.col(vector_col), q), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(top)


def hashed_vector(text: Column, size: int = 64) -> Column:
    """A text's vector of hashed character trigrams: the embedder where no model is given."""
    t = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.pmod(F.hash(F.substr(t, i, F.lit(3))), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(grams, lambda g: g == k)).cast("double"))


# Texts of our own whose vectors are kept, to notice a changed embedder; any texts would do, as long as they stay.
CANARIES = ["customer name", "email address", "order date", "total price", "postal code", "country", "phone number", "quantity", "status", "latitude", "longitude", "description", "category", "user id", "created at", "currency"]


def embedding_drift(spark: SparkSession, kept: DataFrame, threshold: float = 0.05, size: int = 64) -> DataFrame:
    """(text, distance, alarm) between the kept vectors (text, vector) of the canaries and new ones."""
    now = spark.createDataFrame([(c,) for c in CANARIES], "text string").select("text", hashed_vector(F.col("text"), size).alias("now"))
    return now.join(F.broadcast(kept), "text").select("text", F.round(1 - cosine(F.col("now"), F.col("vector")), 6).alias("distance")).withColumn("alarm", F.col("distance") > threshold)
