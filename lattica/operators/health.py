"""Data quality from profiles alone: hotspots, health, radar, drift.  No row of the table is read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRADES = ((0.9, "A"), (0.8, "B"), (0.7, "C"), (0.6, "D"))


def graded(score: Column, scale: float = 1.0) -> Column:
    out = F.lit("F")
    for least, letter in reversed(GRADES):
        out = F.when(score >= least * scale, letter).otherwise(out)
    return out


def hotspots(profiles: DataFrame, traffic: DataFrame | None = None, top: int = 10) -> DataFrame:
    """Columns by risk: nulls, cardinality, spread and, where given, how much they are used (traffic: name, calls)."""
    n = F.col("count")
    null = F.col("null_pct") / 100
    ratio = F.when(n > 0, F.col("cardinality") / n).otherwise(0.0)
    card = F.when(F.col("cardinality") <= 1, 0.8).when((F.col("type") == "string") & (ratio > 0.95), 0.5).otherwise(0.2 * ratio)
    spread = F.col("max").try_cast("double") - F.col("min").try_cast("double")
    outlier = F.when(F.col("type").isin("integer", "float") & (F.abs("mean") > 0), F.least(spread / F.abs("mean") / 5, F.lit(1.0))).otherwise(0.0)
    rows = profiles.select("name", null.alias("null_risk"), card.alias("cardinality_risk"), F.coalesce(outlier, F.lit(0.0)).alias("outlier_risk"))
    if traffic is None:
        score = 0.4 * F.col("null_risk") + 0.3 * F.col("cardinality_risk") + 0.3 * F.col("outlier_risk")
    else:
        most = traffic.agg(F.max("calls").alias("most"))
        rows = rows.join(traffic.select("name", "calls"), "name", "left").crossJoin(F.broadcast(most)).withColumn("traffic_risk", F.coalesce(F.col("calls") / F.nullif(F.col("most"), F.lit(0)), F.lit(0.0)))
        score = 0.3 * F.col("null_risk") + 0.2 * F.col("cardinality_risk") + 0.2 * F.col("outlier_risk") + 0.3 * F.col("traffic_risk")
    rows = rows.withColumn("score", F.round(score, 4))
    level = F.when(F.col("score") >= 0.6, "high").when(F.col("score") >= 0.3, "medium").otherwise("low")
    return rows.select("name", "score", level.alias("level"), F.round("null_risk", 4).alias("null_risk"), F.round("cardinality_risk", 4).alias("cardinality_risk"), F.round("outlier_risk", 4).alias("outlier_risk")).orderBy(F.desc("score"), "name").limit(top)


def _facts(profiles: DataFrame) -> DataFrame:
    typed = F.col("type").isin("string", "integer", "float")
    return profiles.agg(
        F.count(F.lit(1)).alias("columns"), F.avg("null_pct").alias("null_pct"), F.avg("type_confidence").alias("confidence"), F.count_if((F.col("cardinality") <= 1) & (F.col("count") > 0)).alias("constant"),
        F.max("is_primary_key_candidate").alias("has_pk"), F.count_if(typed).alias("candidates"), F.count_if(typed & F.col("semantic_type").isNotNull()).alias("typed"),
    )


def dataset_health(profiles: DataFrame, drift_free: bool = True) -> DataFrame:
    """(score, grade) and its parts, each from 0 to 1."""
    f = _facts(profiles)
    parts = f.select(
        (1 - F.col("null_pct") / 100).alias("nulls"), F.col("confidence").alias("types"), (1 - F.col("constant") / F.col("columns")).alias("constants"), F.when(F.col("has_pk"), 1.0).otherwise(0.5).alias("keys"),
        F.when(F.col("candidates") > 0, F.col("typed") / F.col("candidates")).otherwise(1.0).alias("semantics"), F.lit(1.0 if drift_free else 0.5).alias("stability"),
    )
    score = 0.3 * F.col("nulls") + 0.3 * F.col("types") + 0.1 * (F.col("constants") + F.col("keys") + F.col("semantics") + F.col("stability"))
    return parts.withColumn("score", F.round(score, 4)).withColumn("grade", graded(F.col("score")))


def radar(profiles: DataFrame, drift_free: bool | None = None, coverage: float | None = None) -> DataFrame:
    """(axis, score 0 to 100) rows; absent axes are left out."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    axes = [
        ("null_health", clamp(100 - F.col("null_pct"))),
        ("type_confidence", clamp(100 * F.col("confidence"))),
        ("cardinality_health", clamp(100 - 500 * F.col("constant") / F.col("columns"))),
        ("pk_presence", F.when(F.col("has_pk"), 100.0).otherwise(50.0)),
        ("semantic_coverage", F.when(F.col("candidates") > 0, clamp(100.0 * F.col("typed") / F.col("candidates"))).otherwise(100.0)),
    ]
    if drift_free is not None:
        axes.append(("schema_stability", F.lit(100.0 if drift_free else 50.0)))
    if coverage is not None:
        axes.append(("runtime_coverage", F.lit(float(coverage))))
    return _facts(profiles).select(F.inline(F.array(*[F.struct(F.lit(n).alias("axis"), F.round(c.cast("double"), 2).alias("score")) for n, c in axes])))


def composite(axes: DataFrame) -> DataFrame:
    one = axes.agg(F.round(F.avg("score"), 1).alias("composite"))
    return one.select("composite", graded(F.col("composite"), 100).alias("grade"))


def diff_radar(before: DataFrame, after: DataFrame, threshold: float = 3.0) -> DataFrame:
    """(axis, baseline, current, delta, change) of all axes of either."""
    joined = before.select("axis", F.col("score").alias("baseline")).join(after.select("axis", F.col("score").alias("current")), "axis", "full")
    delta = F.round(F.col("current") - F.col("baseline"), 2)
    return joined.select("axis", "baseline", "current", delta.alias("delta"), F.when(delta <= -threshold, "regression").when(delta >= threshold, "improvement").when(delta.isNull(), "unmatched").otherwise("stable").alias("change"))


def schema_drift(a: DataFrame, b: DataFrame, least: float = 1.0) -> DataFrame:
    """(name, change, before, after) between two profiles: added, removed, type or null-rate changes."""
    left = a.select("name", F.col("type").alias("ta"), F.col("null_pct").alias("na"))
    right = b.select("name", F.col("type").alias("tb"), F.col("null_pct").alias("nb"))
    j = left.join(right, "name", "full")
    change = F.when(F.col("ta").isNull(), "added").when(F.col("tb").isNull(), "removed").when(F.col("ta") != F.col("tb"), "type").when(F.abs(F.col("na") - F.col("nb")) >= least, "null_rate")
    return j.select("name", change.alias("change"), F.col("ta").alias("type_before"), F.col("tb").alias("type_after"), F.round(F.col("nb") - F.col("na"), 1).alias("null_pct_delta")).where("change is not null")


def drift_verdict(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("change").isin("removed", "type")).alias("breaking")).select(F.when(F.col("n") == 0, "identical").when(F.col("breaking") > 0, "breaking").otherwise("additive").alias("verdict"))
