"""Sentiment classification: scorers, splits, metrics, models, quality report."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire import config
from tapewire.functions.labels import blended_label, label_name
from tapewire.functions.settle import settle
from tapewire.functions.stats import ratio
from tapewire.operators.boosting import BoostedModel, fit_boosted
from tapewire.operators.lexicon import score_texts
from tapewire.operators.ranks import value_positions
from tapewire.operators.sets import strata_key

Scorer = Callable[[DataFrame], DataFrame]


def lexicon_scorer(text: str = "headline", general: str | None = None) -> Scorer:
    """Scorer from the domain lexicon and an optional general score column."""

    def score(df: DataFrame) -> DataFrame:
        rows = score_texts(df, text)
        g = F.col(general) if general else F.lit(0.0)
        return rows.withColumn("_p", blended_label(g, F.col("normalised_score"))).select(*df.columns, "_p.*")

    return score


def batch_scorer(load: Callable[[], Callable[[pd.Series], pd.DataFrame]], text: str = "headline") -> Scorer:
    """Scorer around any batch model: loaded once per Python worker, fed Arrow batches.

    The model returns label_name and confidence for a series of texts.
    """

    def score(df: DataFrame) -> DataFrame:
        fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                out = model(batch[text])
                yield batch.assign(label_name=out["label_name"].values, confidence=out["confidence"].values)

        return df.mapInPandas(run, f"{fields}, label_name string, confidence double")

    return score


def stratified_split(df: DataFrame, label: str, text: str, id_col: str, train: float = 0.70, val: float = 0.15, seed: int = config.RANDOM_SEED) -> DataFrame:
    """70/15/15 split of each label, exact to the row, in the order of a seeded MD5 of (label, text, id).

    The order's cuts are found over ranges of the hashes, so no label is ordered in one task; rows then compare
    their hash with the cuts of their label.  Equal rows go together.  A null label is a label.
    """
    return split_by_key(df.withColumn("_key", strata_key(label, text, id_col, seed)), label, train, val).drop("_key")


def split_by_key(keyed: DataFrame, label: str, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """``keyed`` with its ``split``, in the order of the column ``_key`` that ``strata_key`` makes.

    The cuts are one row a label and are sent to the rows: rows stay where they are, however few the labels.
    """
    pos = value_positions(keyed.select(F.coalesce(F.col(label).cast("string"), F.lit("\0")).alias("_stratum"), "_key").withColumn("_one", F.lit(1)), ["_stratum"], "_key", "_one")
    first = lambda share: F.min(F.when(F.col("lo") >= F.round(F.col("size") * share), F.col("_key")))
    cuts = pos.groupBy("_stratum").agg(first(train).alias("_a"), first(train + val).alias("_b"))
    rows = keyed.withColumn("_stratum", F.coalesce(F.col(label).cast("string"), F.lit("\0"))).join(F.broadcast(cuts), "_stratum")
    before = lambda cut: F.col(cut).isNull() | (F.col("_key") < F.col(cut))
    return rows.withColumn("split", F.when(before("_a"), "train").when(before("_b"), "val").otherwise("test")).drop("_stratum", "_a", "_b")


def confusion_counts(df: DataFrame, keys: list[str] | None = None, label: str = "label", pred: str = "prediction") -> DataFrame:
    return df.groupBy(*(keys or []), F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, classes: list[int], label: str = "label", pred: str = "prediction") -> DataFrame:
    """Raw counts and row shares per true label."""
    wide = confusion_counts(df, None, label, pred).groupBy("label").pivot("pred", classes).agg(F.sum("n")).na.fill(0)
    total = sum((F.col(str(c)) for c in classes), F.lit(0))
    return wide.select("label", *[F.col(str(c)).alias(f"pred_{c}") for c in classes], *[F.round(ratio(F.col(str(c)), total), 6).alias(f"share_{c}") for c in classes])


def class_metrics(df: DataFrame, keys: list[str] | None = None, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class from counts; a zero denominator gives 0."""
    keys = keys or []
    c = confusion_counts(df, keys, label, pred)
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    by_true = c.groupBy(*keys, F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_pred = c.groupBy(*keys, F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    m = by_true.join(by_pred, [*keys, "class"], "full").na.fill(0, ["support", "tp", "predicted"])
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    m = m.withColumn("precision", zero("tp", "predicted")).withColumn("recall", zero("tp", "support"))
    f1 = zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return m.withColumn("f1", f1)


def overall_metrics(df: DataFrame, keys: list[str] | None = None, label: str = "label", pred: str = "prediction") -> DataFrame:
    keys = keys or []
    m = class_metrics(df, keys, label, pred)
    return m.groupBy(*keys).agg(
        F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"),
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"),
        F.round(F.avg("f1"), 4).alias("macro_f1"),
        F.sum("support").alias("n"),
    )


def text_terms(text: str = "text", features: int = 1 << 16) -> list[Transformer]:
    """Stages from a text to ``_tf``, the hashed counts of its words and word pairs; nothing is learned."""
    # neighbours are paired by two shifted copies: a slice for each word would copy the whole array for each word
    pairs = "zip_with(slice(_words, 1, size(_words) - 1), slice(_words, 2, size(_words) - 1), (a, b) -> concat(a, ' ', b))"
    grams = f"SELECT *, concat(_words, IF(size(_words) < 2, array(concat_ws(' ', _words)), {pairs})) AS _grams FROM __THIS__"
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[\p{L}\p{N}_]+", gaps=False, minTokenLength=1),
        SQLTransformer(statement=grams),
        HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=features),
    ]


def text_classifier(text: str = "text", label: str = "label", features: int = 1 << 16, max_iter: int = 30) -> Pipeline:
    """Uni- and bigram TF-IDF with multinomial logistic regression."""
    return Pipeline(
        stages=[
            *text_terms(text, features),
            IDF(inputCol="_tf", outputCol="_features"),
            LogisticRegression(featuresCol="_features", labelCol=label, family="multinomial", maxIter=max_iter),
        ]
    )


def with_terms(df: DataFrame, text: str = "text", features: int = 1 << 16) -> DataFrame:
    """``df`` with ``_tf`` in place of the text."""
    return PipelineModel(text_terms(text, features)).transform(df).drop(text, "_words", "_grams")


def fit_text_classifier(train: DataFrame, validation: DataFrame, text: str = "text", label: str = "label", grid: tuple[float, ...] = (0.0, 0.01), features: int = 1 << 16) -> PipelineModel:
    """Choose the regularisation with the best macro F1 on the validation rows; the first of equal ones.

    Texts are cut into terms once, and document frequencies counted once for the whole grid.  Rows that hold
    ``_tf`` already (``with_terms``) are taken as they are and may lack the text.
    """
    counted = lambda df: (df if "_tf" in df.columns else settle(with_terms(df.select(text, label), text, features))).select(label, "_tf")
    train, validation = counted(train), counted(validation)
    *_, idf, lr = text_classifier(text, label, features).getStages()
    weights = idf.fit(train)
    rows = weights.transform(train).select(label, "_features")
    models = [PipelineModel([*text_terms(text, features), weights, lr.fit(rows, {lr.regParam: x})]) for x in grid]
    if len(models) == 1:
        return models[0]
    scores = [macro_f1(of_terms(model).transform(validation), label) for model in models]
    return models[max(range(len(models)), key=scores.__getitem__)]


def of_terms(model: PipelineModel) -> PipelineModel:
    """The stages of a text classifier that follow ``_tf``, for rows that hold it."""
    return PipelineModel(model.stages[-2:])


def macro_f1(df: DataFrame, label: str = "label", pred: str = "prediction") -> float:
    """Mean F1 over the classes that occur; 0 without rows."""
    pairs = df.groupBy(F.col(label).cast("int").alias("y"), F.col(pred).cast("int").alias("p")).count().collect()
    classes = {r["y"] for r in pairs} | {r["p"] for r in pairs}
    f1 = [2 * sum(r["count"] for r in pairs if r["y"] == r["p"] == c) / sum(r["count"] * ((r["y"] == c) + (r["p"] == c)) for r in pairs) for c in classes]
    return sum(f1) / len(f1) if f1 else 0.0


def classifier_scorer(model: PipelineModel, classes: int = 3) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        probs = vector_to_array("probability")
        return out.select(*df.columns, F.col("prediction").cast("int").alias("label"), label_name(F.col("prediction").cast("int")).alias("label_name"), F.array_max(probs).alias("confidence"))

    return score


# ---- tabular model ----------------------------------------------------------


def fit_alpha(df: DataFrame, columns: list[str], label: str = "label", **options: object) -> BoostedModel:
    """Boosted trees of three classes: label -1, 0, 1 is class 0, 1, 2; 200 rounds of depth 4 at rate 0.05 on 80 % of the rows."""
    return fit_boosted(df.withColumn("_y", F.col(label) + 1), columns, "_y", classes=3, **options)


def alpha_probabilities(model: BoostedModel | None, df: DataFrame) -> DataFrame:
    """prob_down, prob_flat, prob_up; uniform without a model.  The model aligns its columns itself."""
    names = ["prob_down", "prob_flat", "prob_up"]
    if model is None:
        return df.select("*", *[F.lit(1.0 / 3).alias(n) for n in names])
    out = model.transform(df)
    return out.select(*df.columns, *[F.get("probability", F.lit(i)).alias(n) for i, n in enumerate(names)])


def feature_importances(model: BoostedModel, top: int = 25) -> list[tuple[str, float]]:
    return model.importances()[:top]


# ---- quality report ---------------------------------------------------------


def band(x: Column, steps: list[tuple[float, float, float, float]], below: Column) -> Column:
    """Piecewise-linear score: for each (from, base, width, rise) with x >= from: base + (x-from)/width*rise."""
    out = None
    for start, base, width, rise in steps:
        value = F.lit(base) if width == 0 else base + (x - start) / width * rise
        out = F.when(x >= start, value) if out is None else out.when(x >= start, value)
    return out.otherwise(below)


def drawdown_score(dd: Column) -> Column:
    return (
        F.when(dd <= 0.05, F.lit(10.0))
        .when(dd <= 0.10, 8.0 - (dd - 0.05) / 0.05 * 2.0)
        .when(dd <= 0.20, 5.0 - (dd - 0.10) / 0.10 * 3.0)
        .when(dd <= 0.40, 2.0 - (dd - 0.20) / 0.20 * 2.0)
        .otherwise(0.0)
    )


QUALITY_DEFAULTS = {
    "accuracy": 0.40,
    "macro_f1": 0.35,
    "weighted_f1": 0.40,
    "sharpe_ratio": 0.5,
    "max_drawdown": 0.20,
    "calmar_ratio": 0.5,
    "hit_rate": 0.50,
    "ic": 0.02,
    "rolling_sharpe_std": 0.5,
    "signal_autocorrelation": 0.3,
}


def quality_report(metrics: DataFrame) -> DataFrame:
    """Predictive, risk and robustness scores, the weighted overall score and its verdict.

    ``metrics``: one row per model; absent or NULL metrics take the defaults.
    """
    c = {k: F.coalesce(F.col(k), F.lit(v)) if k in metrics.columns else F.lit(v) for k, v in QUALITY_DEFAULTS.items()}
    ic1 = F.coalesce(F.col("ic_1"), c["ic"]) if "ic_1" in metrics.columns else c["ic"]
    ic5 = F.coalesce(F.col("ic_5"), c["ic"] * 0.7) if "ic_5" in metrics.columns else c["ic"] * 0.7
    zero = F.lit(0.0)
    acc = band(c["accuracy"], [(0.70, 10.0, 0, 0), (0.60, 7.0, 0.10, 3.0), (0.45, 4.0, 0.15, 3.0), (0.33, 1.0, 0.12, 3.0)], zero)
    mean_f1 = (c["macro_f1"] + c["weighted_f1"]) / 2
    f1 = band(mean_f1, [(0.65, 10.0, 0, 0), (0.50, 6.0, 0.15, 4.0), (0.35, 2.0, 0.15, 4.0)], F.greatest(zero, mean_f1 / 0.35 * 2.0))
    ic = band(F.abs(c["ic"]), [(0.10, 10.0, 0, 0), (0.05, 5.0, 0.05, 5.0)], F.abs(c["ic"]) / 0.05 * 5.0)
    hit = band(c["hit_rate"], [(0.60, 10.0, 0, 0), (0.55, 7.0, 0.05, 3.0), (0.50, 4.0, 0.05, 3.0)], F.greatest(zero, c["hit_rate"] / 0.50 * 4.0))
    sharpe = band(c["sharpe_ratio"], [(2.0, 10.0, 0, 0), (1.5, 8.0, 0.5, 2.0), (1.0, 6.0, 0.5, 2.0), (0.5, 3.0, 0.5, 3.0), (0.0, 0.0, 0.5, 3.0)], zero)
    calmar = band(c["calmar_ratio"], [(3.0, 10.0, 0, 0), (1.5, 6.0, 1.5, 4.0), (0.5, 2.0, 1.0, 4.0)], F.greatest(zero, c["calmar_ratio"] / 0.5 * 2.0))
    decay = F.when(ic1 != 0, F.least(F.lit(10.0), F.abs(ic5) / F.greatest(F.abs(ic1), F.lit(1e-6)) * 10.0)).otherwise(0.0)
    sd, corr = c["rolling_sharpe_std"], F.abs(c["signal_autocorrelation"])
    steady = F.when(sd <= 0.3, 10.0).when(sd <= 0.8, 10.0 - (sd - 0.3) / 0.5 * 5.0).otherwise(F.greatest(zero, 5.0 - (sd - 0.8) * 5.0))
    crowd = F.when(corr <= 0.3, 10.0).when(corr <= 0.7, 10.0 - (corr - 0.3) / 0.4 * 5.0).otherwise(F.greatest(zero, 5.0 - (corr - 0.7) * 10.0))
    out = metrics.select(
        "model",
        F.round(acc * 0.40 + f1 * 0.30 + ic * 0.20 + hit * 0.10, 2).alias("predictive_score"),
        F.round(sharpe * 0.45 + drawdown_score(F.abs(c["max_drawdown"])) * 0.35 + calmar * 0.20, 2).alias("risk_score"),
        F.round(decay * 0.40 + steady * 0.35 + crowd * 0.25, 2).alias("robustness_score"),
        F.create_map(*[x for k in ("accuracy", "macro_f1", "weighted_f1", "sharpe_ratio", "max_drawdown", "ic", "hit_rate") for x in (F.lit(k), c[k])]).alias("metrics_used"),
    )
    w = config.TRUST_WEIGHTS
    overall = F.col("predictive_score") * w["predictive"] + F.col("risk_score") * w["risk"] + F.col("robustness_score") * w["robustness"]
    out = out.withColumn("overall_score", F.round(F.greatest(zero, F.least(F.lit(10.0), overall)), 2))
    s = F.col("overall_score")
    return out.withColumn("verdict", F.when(s >= 7.5, "Excellent").when(s >= 5.5, "Good").when(s >= 3.5, "Fair").otherwise("Poor"))


def model_comparison(df: DataFrame, models: list[str], label: str = "label", pred: str = "prediction") -> DataFrame:
    """Metric rows with one column per model."""
    m = overall_metrics(df, ["model"], label, pred)
    long = m.unpivot("model", ["accuracy", "weighted_f1", "macro_f1"], "metric", "value")
    return long.groupBy("metric").pivot("model", models).agg(F.max("value"))


