"""Phrase lexicon scoring with native array expressions.

Per text: find every whole-word occurrence of every phrase, resolve overlaps in
favour of longer phrases, flip negated phrases, add combination bonuses.  All
steps are column expressions, so a row never leaves the JVM and texts of any
length are scored whole.  Each phrase that occurs costs a few passes over the
text: it is counted and then masked, so that shorter phrases cannot use its
characters again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewire import lexicon_data as ld

SCORE_COLUMNS = [
    "raw_score",
    "normalised_score",
    "lex_label",
    "lex_confidence",
    "matched_bullish",
    "matched_bearish",
    "matched_neutral",
    "combination_bonuses",
]
TOKEN_PATTERN = r"[a-z0-9]+(?:[-'][a-z0-9]+)*"


@dataclass(frozen=True)
class Lexicon:
    """Phrase weights per side, combination rules and negation words."""

    bullish: dict[str, float] = field(default_factory=lambda: ld.BULLISH)
    bearish: dict[str, float] = field(default_factory=lambda: ld.BEARISH)
    neutral: dict[str, float] = field(default_factory=lambda: ld.NEUTRAL)
    combinations: list[tuple[list[str], float, str]] = field(default_factory=lambda: ld.COMBINATIONS)
    negations: list[str] = field(default_factory=lambda: ld.NEGATION_WORDS)
    window: int = ld.NEGATION_WINDOW
    negation_factor: float = ld.NEGATION_FACTOR

    def entries(self) -> list[tuple[str, float, str]]:
        """(phrase, weight, side), longest first; equal lengths keep dictionary order."""
        sides = [(self.bullish, "bullish"), (self.bearish, "bearish"), (self.neutral, "neutral")]
        rows = [(p, float(w), side) for table, side in sides for p, w in table.items()]
        return sorted(rows, key=lambda r: -len(r[0]))


#: Stand for a letter and for another character of a masked phrase; no phrase holds them.
MASK_LETTER, MASK_OTHER = "\u01c1", "\u0001"


def _literal_table(lex: Lexicon) -> Column:
    """Array of (phrase, weight, side, pattern, mask, flipped) from joined strings; Spark folds it into one literal.

    ``pattern`` matches the whole-word phrase; it begins with the phrase's characters, which are searched for in long
    steps, and looks back from its end.  ``flipped`` matches the token text with a negation word shortly before it.
    """
    rows = []
    negations = "|".join(re.escape(w) for w in lex.negations)
    for phrase, weight, side in lex.entries():
        words = re.findall(TOKEN_PATTERN, phrase)
        mask = "".join(MASK_LETTER if c.isalpha() else MASK_OTHER for c in phrase)
        flipped = f" (?:{negations})(?: [^ ]+){{0,{lex.window - 1}}} {' '.join(map(re.escape, words))} " if words and negations else "(?!)"
        rows.append((phrase, str(weight), side, rf"\Q{phrase}\E(?<!\p{{L}}\Q{phrase}\E)(?!\p{{L}})", mask, flipped))
    part = lambda i: F.split(F.lit("\n".join(r[i] for r in rows)), "\n")
    names = ["phrase", "weight", "side", "pattern", "mask", "flipped"]
    return F.arrays_zip(*[(part(i).cast("array<double>") if name == "weight" else part(i)).alias(name) for i, name in enumerate(names)])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def score_texts(df: DataFrame, text: str = "headline", lexicon: Lexicon | None = None, dedupe: bool = False) -> DataFrame:
    """Add raw_score, normalised_score, lex_label, lex_confidence, the matched arrays and the bonuses.

    ``dedupe`` scores each distinct text once and joins the result back, for
    syndicated corpora; AQE picks a broadcast or splits a hot text.
    """
    if dedupe:
        unique = df.where(F.col(text).isNotNull()).select(text).distinct()
        return df.join(score_texts(unique, text, lexicon), text, "left").select(*df.columns, *SCORE_COLUMNS)
    lex = lexicon or Lexicon()
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = df.withColumn("_low", low)
    # Phrases present at all, longest first; each is counted in what longer ones left, then masked.
    present = F.filter(_literal_table(lex), lambda e: F.contains(F.col("_low"), e["phrase"]))
    none = F.transform(F.slice(present, 1, 0), lambda e: F.struct(e.alias("entry"), F.lit(0).alias("n")))

    def take(state: Column, e: Column) -> Column:
        found = F.struct(e.alias("entry"), F.regexp_count(state["text"], e["pattern"]).alias("n"))
        return F.struct(F.regexp_replace(state["text"], e["pattern"], e["mask"]).alias("text"), F.concat(state["found"], F.array(found)).alias("found"))

    kept = F.aggregate(present, F.struct(F.col("_low").alias("text"), none.alias("found")), take, lambda state: F.filter(state["found"], lambda f: f["n"] > 0))
    rows = rows.withColumn("_kept", kept)

    def value(f: Column, words: Column) -> Column:
        flip = F.regexp_like(words, f["entry"]["flipped"])
        return f["n"] * f["entry"]["weight"] * F.when(flip, lex.negation_factor).otherwise(1.0)

    # The token text is an array's element, so that it is made once a row: Spark would put a column's expression
    # into the lambda and cut the text into tokens for each phrase found.
    words = F.concat(F.lit(" "), F.array_join(tokens(F.col("_low")), " "), F.lit(" "))
    summed = lambda w: F.aggregate(F.transform("_kept", lambda f: value(f, w)), F.lit(0.0), lambda a, v: a + v)
    base = F.when(F.size("_kept") > 0, F.get(F.transform(F.array(words), summed), F.lit(0))).otherwise(0.0)

    # A required text counts when it occurs anywhere in the lower-case headline.
    def triggered(required: list[str]) -> Column:
        cond = F.lit(True)
        for r in required:
            cond = cond & F.contains(F.col("_low"), F.lit(r))
        return cond

    bonus = F.lit(0.0)
    for required, amount, _ in lex.combinations:
        bonus = bonus + F.when(triggered(required), F.lit(float(amount))).otherwise(0.0)
    notes = F.array_compact(F.array(*[F.when(triggered(req), F.lit(note)) for req, _, note in lex.combinations]))
    rows = rows.withColumn("raw_score", F.round(base + bonus, 9))
    rows = rows.withColumn("normalised_score", F.tanh(F.col("raw_score") / 5.0))

    def matched(side: str) -> Column:
        own = F.filter("_kept", lambda f: f["entry"]["side"] == side)
        return F.flatten(F.transform(own, lambda f: F.array_repeat(f["entry"]["phrase"], f["n"])))

    norm = F.col("normalised_score")
    return rows.select(
        *df.columns,
        "raw_score",
        "normalised_score",
        F.when(norm > 0.15, "bullish").when(norm < -0.15, "bearish").otherwise("neutral").alias("lex_label"),
        F.least(F.abs(norm), F.lit(1.0)).alias("lex_confidence"),
        matched("bullish").alias("matched_bullish"),
        matched("bearish").alias("matched_bearish"),
        matched("neutral").alias("matched_neutral"),
        notes.alias("combination_bonuses"),
    )


def phrase_counts(scored: DataFrame, side: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, phrase, count) of one side's matches."""
    keys = keys or []
    # explode_outer: a plain explode makes Spark infer a size filter and evaluate the whole scorer a second time.
    rows = scored.select(*keys, F.explode_outer(f"matched_{side}").alias("phrase")).where("phrase is not null")
    return rows.groupBy(*keys, "phrase").agg(F.count("*").alias("count"))


def top_phrases(scored: DataFrame, side: str, n: int, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    counts = phrase_counts(scored, side, keys)
    if not keys:
        return counts.orderBy(F.desc("count"), "phrase").limit(n)
    w = W.partitionBy(*keys).orderBy(F.desc("count"), "phrase")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def corpus_summary(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean score and label counts."""
    label = F.col("lex_label")
    return scored.groupBy(*(keys or [])).agg(
        F.round(F.avg("normalised_score"), 4).alias("avg_score"),
        F.count_if(label == "bullish").alias("bullish_count"),
        F.count_if(label == "bearish").alias("bearish_count"),
        F.count_if(label == "neutral").alias("neutral_count"),
        F.count("*").alias("headline_count"),
    )


def ticker_lexicon(scored: DataFrame, top: int = 5) -> DataFrame:
    """Per ticker: mean score, label counts and the most frequent phrases per side."""
    out = corpus_summary(scored, ["ticker"])
    for side in ("bullish", "bearish"):
        best = top_phrases(scored, side, top, ["ticker"])
        # At most ``top`` phrases per ticker reach the list.
        lists = best.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("rank", "phrase"))).alias("_l"))
        lists = lists.select("ticker", F.transform("_l", lambda s: s["phrase"]).alias(f"{side}_phrases"))
        out = out.join(lists, "ticker", "left").withColumn(f"{side}_phrases", F.coalesce(f"{side}_phrases", F.array().cast("array<string>")))
    return out


def label_shares(scored: DataFrame) -> DataFrame:
    total = scored.agg(F.count("*")).scalar()
    per = scored.groupBy("lex_label").agg(F.count("*").alias("n"), F.avg("normalised_score").alias("mean_score"))
    return per.withColumn("share", F.col("n") / total)
