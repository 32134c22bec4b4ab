"""Recommendations for all tickers in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewire import config
from tapewire.functions.dates import recency_weight
from tapewire.functions.labels import signal_of
from tapewire.functions.settle import settle
from tapewire.functions.stats import ratio
from tapewire.operators import keywords as kw
from tapewire.operators import transmission as tr
from tapewire.operators.lexicon import score_texts
from tapewire.operators.patterns import with_weights
from tapewire.operators.sets import source_weight
from tapewire.rule_data import FRIENDLY_REGIMES, HOSTILE_REGIMES


def weighted_rows(scored: DataFrame, weights: dict[str, float] | DataFrame, now: Column, decay: float = config.RECENCY_LAMBDA) -> DataFrame:
    """Per-headline source, keyword, recency and lexicon weights.

    ``weights``: keywords written in the program with their CARs, or a table (keyword, avg_CAR).
    """
    rows = score_texts(scored, dedupe=True)
    if isinstance(weights, DataFrame):
        rows = with_weights(rows, weights).withColumn("best_kw", F.col("best_keyword")).drop("keyword_total", "best_keyword")
    else:
        rows = rows.withColumn("best_kw", kw.best_keyword(F.col("headline"), weights))
    sentiment = signal_of("label_name").cast("double")
    return rows.select(
        "*",
        sentiment.alias("sentiment"),
        source_weight("source").alias("source_w"),
        kw.weight_of_best(F.col("best_kw")).alias("keyword_w"),
        recency_weight(now, "date", decay).alias("recency_w"),
        kw.agreement_weight(F.col("normalised_score"), sentiment).alias("lexicon_w"),
    )


def score_cube(weighted: DataFrame, threshold: float = config.CONFIDENCE_THRESHOLD) -> DataFrame:
    """The one pass over the headlines: partial sums per (ticker, source, phrase).

    Each headline gives one row without a phrase, which carries its numbers, and
    one row per matched phrase.  The result is bounded by tickers x sources x
    lexicon, whatever the number of headlines, and everything else reads it.
    """
    tagged = lambda side: F.transform(F.col(f"matched_{side}"), lambda p: F.struct(F.lit(side).alias("side"), p.alias("phrase")))
    nothing = F.struct(F.lit(None).cast("string").alias("side"), F.lit(None).cast("string").alias("phrase"))
    rows = weighted.withColumn("_t", F.explode_outer(F.concat(F.array(nothing), tagged("bullish"), tagged("bearish"))))
    whole = F.col("_t.phrase").isNull()
    sure = whole & (F.col("confidence") >= threshold)
    w = F.col("source_w") * F.col("keyword_w") * F.col("recency_w") * F.col("lexicon_w")
    voting = sure & (F.col("sentiment") != 0)
    label = F.col("label_name")
    return rows.groupBy("ticker", "source", "_t").agg(
        F.count("*").alias("n"),
        F.count_if(sure).alias("n_sure"),
        F.sum(F.when(sure, F.col("confidence"))).alias("sure_conf"),
        F.sum(F.when(whole, F.col("confidence"))).alias("all_conf"),
        F.sum(F.when(voting, F.col("sentiment") * w * F.col("confidence"))).alias("num"),
        F.sum(F.when(voting, w)).alias("den"),
        F.sum(F.when(sure, F.col("source_w"))).alias("source_sum"),
        F.count_if(sure & (label == "positive")).alias("n_pos"),
        F.count_if(sure & (label == "negative")).alias("n_neg"),
        F.count_if(whole & (label == "positive")).alias("all_pos"),
        F.count_if(whole & (label == "negative")).alias("all_neg"),
        F.sum(F.when(whole, F.col("normalised_score"))).alias("lex_sum"),
        F.max(F.when(sure, F.struct("source_w", "source"))).alias("best_source"),
        F.max(F.when(sure, F.col("best_kw"))).alias("best_kw"),
    ).select("*", "_t.side", "_t.phrase").drop("_t")


def ticker_scores(cube: DataFrame) -> DataFrame:
    """Counts, means and the composite score per ticker."""
    total = lambda c: F.sum(c).alias(c)
    s = cube.where("phrase is null").groupBy("ticker").agg(
        F.sum("n").alias("headline_count"),
        *[total(c) for c in ("n_sure", "sure_conf", "all_conf", "num", "den", "source_sum", "n_pos", "n_neg", "all_pos", "all_neg", "lex_sum")],
        F.max("best_source").alias("best_source"),
        F.max("best_kw").alias("best_kw"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("source_breakdown"),
    )
    return s.select(
        "ticker",
        "headline_count",
        "n_sure",
        ratio("sure_conf", "n_sure").alias("sure_conf"),
        ratio("all_conf", "headline_count").alias("all_conf"),
        ratio("source_sum", "n_sure").alias("source_quality"),
        "n_pos",
        "n_neg",
        "all_pos",
        "all_neg",
        F.round(ratio("lex_sum", "headline_count"), 4).alias("avg_score"),
        "best_source",
        "best_kw",
        "source_breakdown",
        F.round(F.coalesce(ratio("num", "den"), F.lit(0.0)), 6).alias("signal_score"),
    )


def top_phrases(cube: DataFrame, side: str, top: int = 5) -> DataFrame:
    """Most frequent phrases of one side per ticker, as a list of at most ``top``."""
    counts = cube.where(F.col("side") == side).groupBy("ticker", "phrase").agg(F.sum("n").alias("n"))
    w = W.partitionBy("ticker").orderBy(F.desc("n"), "phrase")
    best = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    lists = best.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("_r", "phrase"))).alias("_l"))
    return lists.select("ticker", F.transform("_l", lambda x: x["phrase"]).alias(f"{side}_phrases"))


def side_of(score: Column) -> Column:
    return F.when(score > config.BUY_THRESHOLD, "BUY").when(score < config.SELL_THRESHOLD, "SELL").otherwise("HOLD")


def _reasoning() -> Column:
    c = F.col
    direction = F.when(c("n_pos") > c("n_neg"), "positive").when(c("n_neg") > c("n_pos"), "negative").otherwise("mixed")
    neutral = c("n_sure") - c("n_pos") - c("n_neg")
    lex = tr.signed(c("avg_score"), 2)
    listed = lambda col: F.concat_ws(", ", F.slice(col, 1, 3))
    keyword = F.when(
        c("best_kw").isNotNull(),
        F.concat(
            F.lit("Keyword '"), c("best_kw.k"), F.lit("' detected (historically "), F.when(c("best_kw.car") > 0, "positive").otherwise("negative"),
            F.lit(" avg CAR="), tr.signed(c("best_kw.car") * 100, 2), F.lit("%)."),
        ),
    )
    text = F.concat_ws(
        " ",
        F.format_string("%d of %d confident headlines classified positive, %d negative, %d neutral (overall sentiment: %s).", "n_pos", "n_sure", "n_neg", neutral, direction),
        F.format_string("Highest-credibility source: %s (weight=%.1f).", "best_source.source", "best_source.source_w"),
        keyword,
        F.when((c("n_pos") > 0) & (c("n_neg") > 0), F.format_string("Signal partially dampened by %d negative headline(s) countering %d positive one(s).", "n_neg", "n_pos")),
        F.when(F.size("bullish_phrases") > 0, F.concat(F.lit("Lexicon detected bullish signals: "), listed("bullish_phrases"), F.lit(" (lexicon score: "), lex, F.lit(")."))),
        F.when(F.size("bearish_phrases") > 0, F.concat(F.lit("Lexicon detected bearish signals: "), listed("bearish_phrases"), F.lit(" (lexicon score: "), lex, F.lit(")."))),
        F.when((F.size("bullish_phrases") > 0) & (F.size("bearish_phrases") > 0), "Mixed lexicon signals — both bullish and bearish phrases present."),
        F.concat(F.lit("Composite signal score: "), tr.signed(c("signal_score"), 3), F.lit(".")),
    )
    none = F.lit(f"No headlines met the confidence threshold of {config.CONFIDENCE_THRESHOLD:.0%}. Defaulting to HOLD.")
    return F.when(c("n_sure") == 0, none).otherwise(text)


def conviction_points(min_headlines: int = config.MIN_CONFIDENT_HEADLINES, min_source: float = config.MIN_SOURCE_QUALITY) -> Column:
    c = F.col
    agree = (c("investment_view") == "POSITIVE") & (c("tactical_signal") == "BUY") | (c("investment_view") == "NEGATIVE") & (c("tactical_signal") == "SELL")
    checks = [
        c("confident_headline_count") >= min_headlines,
        F.abs("signal_score") >= 0.55,
        F.coalesce("source_quality", F.lit(0.0)) >= min_source,
        (c("avg_score") * c("signal_score") > 0) & (F.abs("avg_score") > 0.15),
        (c("macro_regime") != "") & agree,
    ]
    return sum((F.coalesce(x, F.lit(False)).cast("int") for x in checks), F.lit(0))


def recommend(
    scored: DataFrame,
    universe: DataFrame,
    context: DataFrame,
    weights: dict[str, float] | DataFrame,
    now: Column,
    members: dict[str, str] | None = None,
    quality: float = 0.0,
    strict: bool = False,
) -> DataFrame:
    """One row per universe ticker.  ``context`` is the single latest context row.

    Tickers without headlines come out as HOLD.
    """
    cube = settle(score_cube(weighted_rows(scored, weights, now)))
    t = ticker_scores(cube)
    for side in ("bullish", "bearish"):
        t = t.join(top_phrases(cube, side), "ticker", "left")
        t = t.withColumn(f"{side}_phrases", F.coalesce(f"{side}_phrases", F.array().cast("array<string>")))
    one = context.select(
        F.struct("regime", "vix", "commodity_stress", "events").alias("ctx")
    ).scalar()
    t = t.withColumn("ctx", one)
    none_sure = F.col("n_sure") == 0
    t = t.withColumn("confident_headline_count", F.when(none_sure, F.col("headline_count")).otherwise(F.col("n_sure")))
    t = t.withColumn("confidence", F.when(none_sure, F.col("all_conf")).otherwise(F.col("sure_conf")))
    t = t.withColumn("p_cnt", F.when(none_sure, F.col("all_pos")).otherwise(F.col("n_pos"))).withColumn("n_cnt", F.when(none_sure, F.col("all_neg")).otherwise(F.col("n_neg")))
    t = t.withColumn("sectors", tr.ticker_sectors(F.col("ticker"), members))
    t = t.withColumn("exposure", tr.exposure(F.col("sectors"), F.col("ctx.events"))).withColumn("risk_flags", tr.risk_flags(F.col("sectors"), F.col("ctx.events")))
    adjusted, reasons = tr.context_adjustment(F.col("signal_score"), F.col("exposure.net_exposure"), F.col("ctx.regime"), F.col("ctx.vix"), F.col("ctx.commodity_stress"))
    t = t.withColumn("adjusted_signal_score", adjusted).withColumn("_why", reasons).withColumn("macro_regime", F.coalesce("ctx.regime", F.lit("")))
    t = t.withColumn("tactical_signal", side_of(F.col("signal_score")))
    friendly, hostile = F.col("macro_regime").isin(FRIENDLY_REGIMES), F.col("macro_regime").isin(HOSTILE_REGIMES)
    view = F.when(friendly & (F.col("adjusted_signal_score") > 0.1), "POSITIVE").when(hostile | (F.col("adjusted_signal_score") < -0.1), "NEGATIVE").otherwise("NEUTRAL")
    t = t.withColumn("investment_view", view).withColumn("conviction_points", conviction_points())
    level = F.when(F.col("conviction_points") >= 4, "HIGH").when(F.col("conviction_points") >= 2, "MEDIUM").otherwise("LOW")
    t = t.withColumn("conviction_level", level)
    effective = F.when(F.col("adjusted_signal_score") != 0, F.col("adjusted_signal_score")).otherwise(F.col("signal_score"))
    t = t.withColumn("recommendation", side_of(effective))
    if strict:
        t = strict_gates(t, quality)
    drivers = F.array_compact(
        F.array(
            F.when(F.col("p_cnt") > F.col("n_cnt"), F.format_string("Positive news sentiment (%d/%d confident headlines)", "p_cnt", "confident_headline_count")),
            F.when((F.col("avg_score") > 0.1) & (F.size("bullish_phrases") > 0), F.concat(F.lit("Bullish lexicon signals: "), F.concat_ws(", ", F.slice("bullish_phrases", 1, 2)))),
        )
    )
    t = t.withColumn("drivers", F.concat(drivers, F.slice("_why", 1, 2))).withColumn("reasoning", _reasoning())
    out = universe.select("ticker").distinct().join(t, "ticker", "left")
    missing = F.col("headline_count").isNull()
    empty = F.array().cast("array<string>")
    fill = lambda col, value: F.when(missing, value).otherwise(F.col(col))
    return out.select(
        "ticker",
        fill("recommendation", F.lit("HOLD")).alias("recommendation"),
        F.round(fill("confidence", F.lit(0.0)), 4).alias("confidence"),
        F.round(fill("signal_score", F.lit(0.0)), 4).alias("signal_score"),
        fill("headline_count", F.lit(0)).cast("long").alias("headline_count"),
        fill("confident_headline_count", F.lit(0)).cast("long").alias("confident_headline_count"),
        F.round(fill("avg_score", F.lit(0.0)), 4).alias("lexicon_score"),
        fill("bullish_phrases", empty).alias("top_positive_keywords"),
        fill("bearish_phrases", empty).alias("top_negative_keywords"),
        "source_breakdown",
        fill("reasoning", F.lit("No headlines available. Defaulting to HOLD.")).alias("reasoning"),
        fill("macro_regime", F.lit("")).alias("macro_regime"),
        F.lit(round(float(quality), 2)).alias("model_quality_score"),
        fill("drivers", empty).alias("drivers"),
        fill("risk_flags", empty).alias("risk_flags"),
        F.round(fill("adjusted_signal_score", F.lit(0.0)), 4).alias("adjusted_signal_score"),
        fill("tactical_signal", F.lit("HOLD")).alias("tactical_signal"),
        fill("investment_view", F.lit("NEUTRAL")).alias("investment_view"),
        fill("conviction_level", F.lit("LOW")).alias("conviction_level"),
        fill("conviction_points", F.lit(0)).alias("conviction_points"),
        F.lit(now).alias("generated_at"),
    )


def strict_gates(t: DataFrame, quality: float, min_quality: float = config.MIN_MODEL_QUALITY, min_headlines: int = config.MIN_CONFIDENT_HEADLINES) -> DataFrame:
    """Optional gates that turn a BUY or SELL into HOLD and note why, in order."""

    def gate(df: DataFrame, cond: Column, note: Column | None) -> DataFrame:
        hit = cond & (F.col("recommendation") != "HOLD")
        out = df.withColumn("_hit", F.coalesce(hit, F.lit(False)))
        if note is not None:
            out = out.withColumn("risk_flags", F.when(F.col("_hit"), F.concat("risk_flags", F.array(note))).otherwise(F.col("risk_flags")))
        return out.withColumn("recommendation", F.when(F.col("_hit"), "HOLD").otherwise(F.col("recommendation"))).drop("_hit")

    if 0 < quality < min_quality:
        t = gate(t, F.lit(True), F.lit(f"Model quality ({quality:.1f}) below trade floor ({min_quality:.1f})"))
    few = F.col("confident_headline_count") < min_headlines
    t = gate(t, few, F.format_string(f"Insufficient confident headlines (%d < {min_headlines})", "confident_headline_count"))
    buy, low = F.col("recommendation") == "BUY", F.col("conviction_level") == "LOW"
    hostile = F.col("macro_regime").isin(HOSTILE_REGIMES)
    t = gate(t, hostile & buy & low, F.concat(F.lit("Macro regime ("), F.replace("macro_regime", F.lit("_"), F.lit(" ")), F.lit(") hostile — BUY suppressed")))
    t = gate(t, (F.size("risk_flags") >= 2) & (F.col("adjusted_signal_score") < F.col("signal_score") * 0.5) & buy, None)
    return gate(t, low, F.lit("Signal conviction too low — holding instead of trading"))


def scan_order(results: DataFrame) -> DataFrame:
    """BUY by score, then HOLD by score, then SELL with the most negative first."""
    rank = F.when(F.col("recommendation") == "BUY", 0).when(F.col("recommendation") == "SELL", 2).otherwise(1)
    key = F.when(F.col("recommendation") == "SELL", F.col("signal_score")).otherwise(-F.col("signal_score"))
    return results.orderBy(rank, key, "ticker")


def ranked_book(results: DataFrame, max_positions: int = config.MAX_POSITIONS, cap: float = config.MAX_POSITION_SIZE, min_quality: float = config.MIN_MODEL_QUALITY) -> DataFrame:
    """Long book: convinced BUYs, top ``max_positions`` by adjusted score, capped and renormalised weights."""
    quality = F.col("model_quality_score")
    longs = results.where((F.col("recommendation") == "BUY") & F.col("conviction_level").isin("HIGH", "MEDIUM") & ((quality == 0) | (quality >= min_quality)))
    top = longs.orderBy(F.desc("adjusted_signal_score"), "ticker").limit(max_positions)
    # At most max_positions rows from here on.
    every = W.partitionBy(F.lit(1))
    s = F.greatest(F.lit(0.0), F.col("adjusted_signal_score"))
    total = F.sum("_s").over(every)
    top = top.withColumn("_s", s).withColumn("_w", F.least(F.col("_s") / F.when(total > 0, total).otherwise(1.0), F.lit(cap)))
    summed = F.sum("_w").over(every)
    return top.withColumn("position_weight", F.round(F.col("_w") / F.when(summed > 0, summed).otherwise(1.0), 4)).drop("_s", "_w")


def compare(results: DataFrame, tickers: list[str]) -> DataFrame:
    return results.where(F.upper("ticker").isin([t.upper() for t in tickers]))


def recommendation_changes(history: DataFrame) -> DataFrame:
    """Rows where a ticker's recommendation differs from its previous one."""
    w = W.partitionBy("ticker").orderBy("ts")
    rows = history.withColumn("previous", F.lag("recommendation").over(w))
    return rows.where("previous is not null and previous <> recommendation")


def summary_table(results: DataFrame) -> DataFrame:
    """Flat report table: arrays joined, timestamp formatted."""
    return results.select(
        "ticker",
        "recommendation",
        "tactical_signal",
        "investment_view",
        "conviction_level",
        "signal_score",
        "adjusted_signal_score",
        "confidence",
        "headline_count",
        "confident_headline_count",
        "macro_regime",
        "model_quality_score",
        F.concat_ws(", ", "top_positive_keywords").alias("top_positive_keywords"),
        F.concat_ws(", ", "top_negative_keywords").alias("top_negative_keywords"),
        F.concat_ws(" | ", "drivers").alias("drivers"),
        F.concat_ws(" | ", "risk_flags").alias("risk_flags"),
        "reasoning",
        F.date_format("generated_at", "yyyy-MM-dd HH:mm").alias("generated_at"),
    )
