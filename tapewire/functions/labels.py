"""Label, position and class expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewire import config
from tapewire.functions.dates import ColumnLike, _c


def signal_of(label: ColumnLike, mapping: dict[str, int] | None = None, inverted: bool = False) -> Column:
    """Map a label name to its trading signal; unmapped labels count as 0."""
    pairs = (mapping or config.SIGNAL_MAP).items()
    lookup = F.create_map(*[F.lit(v) for kv in pairs for v in kv])
    value = F.coalesce(F.try_element_at(lookup, _c(label)), F.lit(0))
    return -value if inverted else value


def position_of(signal: ColumnLike, buy: ColumnLike | float = config.BUY_THRESHOLD, sell: ColumnLike | float = config.SELL_THRESHOLD) -> Column:
    s = _c(signal)
    b = F.lit(buy) if isinstance(buy, float) else _c(buy)
    t = F.lit(sell) if isinstance(sell, float) else _c(sell)
    return F.when(s > b, 1).when(s < t, -1).otherwise(0)


def side_name(position: ColumnLike) -> Column:
    p = _c(position)
    return F.when(p > 0, "long").when(p < 0, "short").otherwise("hold")


def sentiment_class(score: ColumnLike) -> Column:
    s = _c(score)
    return F.when(s < -0.1, 0).when(s > 0.1, 2).otherwise(1)


def label_name(label: ColumnLike) -> Column:
    lookup = F.create_map(*[F.lit(v) for kv in config.LABEL_NAMES.items() for v in kv])
    return F.try_element_at(lookup, _c(label))


def return_class(ret: ColumnLike, band: float = 0.005) -> Column:
    r = _c(ret)
    return F.when(r > band, 1).when(r < -band, -1).otherwise(0)


def label_from_probabilities(probs: ColumnLike, threshold: float = config.CONFIDENCE_THRESHOLD) -> Column:
    """Struct (label, label_name, confidence, probabilities) from an array (negative, neutral, positive)."""
    p = _c(probs)
    best = F.array_max(p)
    arg = (F.array_position(p, best) - 1).cast("int")
    sure = best >= threshold
    names = [F.lit(v) for v in config.LABEL_NAMES.values()]
    return F.struct(
        F.when(sure, arg).otherwise(F.lit(1)).alias("label"),
        F.when(sure, label_name(arg)).otherwise(F.lit("uncertain")).alias("label_name"),
        F.round(best, 4).alias("confidence"),
        F.map_from_arrays(F.array(*names), F.transform(p, lambda v: F.round(v, 4))).alias("probabilities"),
    )


def blended_label(general: ColumnLike, domain: ColumnLike, general_weight: float = 0.4, domain_weight: float = 0.6) -> Column:
    """Label from a general and a domain lexicon score; a missing score counts as 0."""
    g = F.coalesce(_c(general), F.lit(0.0)) * general_weight
    blend = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), g + F.coalesce(_c(domain), F.lit(0.0)) * domain_weight))
    label = F.when(blend > 0.05, 2).when(blend < -0.05, 0).otherwise(1)
    conf = F.round(F.least(F.abs(blend), F.lit(1.0)), 4)
    names = list(config.LABEL_NAMES.items())
    probs = F.map_from_arrays(
        F.array(*[F.lit(n) for _, n in names]), F.array(*[F.when(label == i, conf).otherwise(0.0) for i, _ in names])
    )
    return F.struct(label.alias("label"), label_name(label).alias("label_name"), conf.alias("confidence"), probs.alias("probabilities"))
