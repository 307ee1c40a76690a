"""Priors, losses, a linear pairwise ranker and the gate that promotes it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import linear, softplus
from ..sidecars import read_json, write_json
from ..storage import stage
from . import metrics
from .candidates import ENRICHED

def _without(*names: str) -> tuple[str, ...]:
    return tuple(x for x in ENRICHED if x not in names)


_FLAGS = tuple(x for x in ENRICHED if x.startswith("from_"))
# The feature subsets that the ablation compares.
ABLATIONS = {
    "linear_all_features": ENRICHED,
    "without_category": _without("category_share"),
    "without_recency": _without("recency_share"),
    "without_max_similarity": _without("max_similarity"),
    "without_source_flags": _without(*_FLAGS),
    "retrieval_core": ("score_share", "log_popularity", "reciprocal_rank", "source_share", "history_size", "rrf_share"),
    "hybrid_features": ("rrf_share", *_FLAGS),
}


def retrieval_prior(prefix: str = "") -> Column:
    """2 * fused share + 0.02 / rank."""
    return F.col(f"{prefix}rrf_share") * 2.0 + F.col(f"{prefix}reciprocal_rank") * 0.02


def bounded_prior() -> Column:
    """The pointwise ranker's prior: 8 * (score share + 0.01 / rank) - 4."""
    return (F.col("score_share") + F.col("reciprocal_rank") * 0.01) * 8.0 - 4.0


def pair_loss(pairs: DataFrame, positive: Column, negative: Column) -> DataFrame:
    """One row: pairs, and the weighted mean of softplus(-(positive - negative))."""
    each = pairs.select("weight", softplus(negative - positive).alias("loss"))
    return each.agg(F.count("*").alias("pairs"), F.round(F.sum(F.col("loss") * F.col("weight")) / F.sum("weight"), 8).alias("loss"))


def list_loss(examples: DataFrame, score: Column) -> DataFrame:
    """One row: groups, and the mean softmax cross-entropy of the positive in its group."""
    own = Window.partitionBy("example_id")
    shifted = examples.withColumn("score", score).withColumn("top", F.max("score").over(own)).withColumn("mass", F.sum(F.exp(F.col("score") - F.col("top"))).over(own))
    each = shifted.filter("label = 1").select((F.log("mass") - (F.col("score") - F.col("top"))).alias("loss"))
    return each.agg(F.count("*").alias("groups"), F.round(F.avg("loss"), 8).alias("loss"))


def positive_weight(examples: DataFrame) -> DataFrame:
    """One row: negatives for each positive."""
    return examples.agg(F.round(F.count_if(F.col("label") == 0) / F.greatest(F.count_if(F.col("label") == 1), F.lit(1)), 8).alias("positive_weight"))


def difference_rows(pairs: DataFrame, features: list[str]) -> DataFrame:
    """Feature differences with the prior's difference as offset, each pair also mirrored with label 0: their
    logistic likelihood is the pair loss."""
    from pyspark.ml.feature import VectorAssembler

    offset = retrieval_prior("p_") - retrieval_prior("n_")
    ways = F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("sign")
    rows = pairs.select("weight", offset.alias("prior"), *((F.col(f"p_{x}") - F.col(f"n_{x}")).alias(x) for x in features), ways)
    signed = rows.select("weight", (F.col("prior") * F.col("sign")).alias("prior"), *((F.col(x) * F.col("sign")).alias(x) for x in features), (F.col("sign") > 0).cast("double").alias("label"))
    return VectorAssembler(inputCols=features, outputCol="features").transform(signed)


def fit_linear(pairs: DataFrame, features: tuple[str, ...] = ABLATIONS["without_source_flags"], ridge: float = 1e-3, steps: int = 50, rows: DataFrame | None = None) -> dict[str, float]:
    """Weights of the linear correction of the retrieval prior after so many steps, by weighted logistic
    regression with offset. rows: difference_rows of the pairs, if they are there."""
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = difference_rows(pairs, list(features)) if rows is None else rows
    model = GeneralizedLinearRegression(family="binomial", link="logit", fitIntercept=False, offsetCol="prior", weightCol="weight", regParam=ridge, maxIter=steps)
    return dict(zip(features, model.fit(rows).coefficients.toArray().tolist(), strict=True))


@dataclass(frozen=True)
class Trained:
    """weights of the best epoch (none if that is the prior), and the validation value of each epoch from 0, the prior."""

    weights: dict[str, float]
    best_epoch: int
    values: list[float]


def prior_order() -> list[Column]:
    return [F.desc("rrf_share"), F.desc("reciprocal_rank"), F.col("candidate_item_id")]


def train(pairs: DataFrame, judged: DataFrame, features: tuple[str, ...] = ABLATIONS["without_source_flags"], epochs: int = 10, patience: int = 3, k: int = 10) -> Trained:
    """Fit step by step; after each, NDCG at k of the validation groups `judged`. Stops after `patience` steps
    without a gain; the best epoch counts, which is 0 where nothing beats the prior."""
    value = lambda order, rows: metrics.group_metrics(rows, order, [k]).first()["ndcg"]
    rows = stage(difference_rows(pairs, list(features)), "differences")
    values, fits = [value(prior_order(), judged)], [{}]
    while len(values) <= epochs and len(values) - 1 - early_stop(values, patience) < patience:
        fits.append(fit_linear(pairs, features, steps=len(values), rows=rows))
        values.append(value([F.desc("score"), F.col("candidate_item_id")], judged.withColumn("score", F.round(corrected(fits[-1]), 8))))
    best = early_stop(values, patience)
    return Trained(fits[best], best, values)


def ablate(pairs: DataFrame, judged: DataFrame, subsets: dict[str, tuple[str, ...]] | None = None, epochs: int = 10, patience: int = 2, k: int = 10) -> tuple[str, dict[str, Trained]]:
    """(name of the best subset, the first of equal ones; all of them trained)"""
    made = {name: train(pairs, judged, own, epochs, patience, k) for name, own in (subsets or ABLATIONS).items()}
    return choose({name: x.values[x.best_epoch] for name, x in made.items()}), made


def save(spark: SparkSession, path: str, ranker: Trained) -> None:
    write_json(spark, path, vars(ranker))


def load(spark: SparkSession, path: str) -> Trained:
    found = read_json(spark, path)
    if found is None:
        raise LookupError(f"no ranker at {path}")
    return Trained(**found)


def corrected(weights: dict[str, float]) -> Column:
    """The prior plus a linear correction."""
    return retrieval_prior() + linear([F.col(x) for x in weights], list(weights.values()))


def promote(prior_ndcg: float, new_ndcg: float, best_epoch: int, least_pct: float = 5.0) -> bool:
    """A trained ranker is served only if it beat its own start and lifts the metric enough."""
    return best_epoch > 0 and prior_ndcg > 0 and (new_ndcg / prior_ndcg - 1) * 100 >= least_pct


def early_stop(values: list[float], patience: int = 3, least: float = 1e-6) -> int:
    """The best epoch of validation values by epoch (0: the prior), stopping after `patience` without a gain."""
    best, at = values[0], 0
    for epoch, value in enumerate(values[1:], 1):
        if value > best + least:
            best, at = value, epoch
        elif epoch - at >= patience:
            break
    return at


def choose(candidates: dict[str, float]) -> str:
    """The name with the largest value; of equal ones the first."""
    return max(candidates, key=candidates.get)
