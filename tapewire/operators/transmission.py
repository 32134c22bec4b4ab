"""Transmission events, sector exposure, risk flags and the context adjustment.

A date has at most one event per driver (five), so its events are a short array
on the date's context row; tickers meet it by an equi-join on date or as one
latest row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.functions.stats import clip
from tapewire.rule_data import REGIME_BIAS, RULES, SECTOR_MEMBERS


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _rule_table() -> Column:
    rows = []
    for i, (key, driver, state, trigger, first, second, pos, neg, risk) in enumerate(RULES):
        first_text = first.replace("_", " ").title() + " — " + trigger.split("(")[0].strip()
        rows.append(
            F.struct(
                F.lit(-risk).alias("_by_risk"),
                F.lit(i).alias("_order"),
                F.lit(key).alias("rule"),
                F.lit(driver).alias("driver"),
                F.lit(state).alias("state"),
                F.lit(first_text).alias("flag"),
                F.lit(second.replace("_", " ").replace("-", " ")).alias("second_order"),
                _words(pos).alias("positive"),
                _words(neg).alias("negative"),
                F.lit(risk).alias("risk_level"),
            )
        )
    return F.array(*rows)


def active_events(states: dict[str, Column]) -> Column:
    """Events whose driver is in the rule's state, highest risk first."""
    lookup = F.create_map(*[x for name, col in states.items() for x in (F.lit(name), col)])
    hits = F.filter(_rule_table(), lambda r: F.coalesce(F.try_element_at(lookup, r["driver"]) == r["state"], F.lit(False)))
    return F.array_sort(hits)


def context_rows(macro: DataFrame, commodities: DataFrame) -> DataFrame:
    """(date, regime, vix, commodity_stress, events) per date."""
    rows = macro.join(commodities, "date")
    states = {n: F.col(f"{n}_shock") for n in ("oil", "gas", "copper", "gold")} | {"regime": F.col("regime")}
    return rows.withColumn("events", active_events(states))


def event_table(context: DataFrame) -> DataFrame:
    return context.select("date", F.posexplode("events").alias("rank", "e")).select(
        "date", (F.col("rank") + 1).alias("rank"), "e.rule", "e.risk_level", "e.positive", "e.negative", "e.flag", "e.second_order"
    )


def chain_features(context: DataFrame) -> DataFrame:
    """Event count, risk levels and one flag per rule."""
    risk = F.transform("events", lambda e: e["risk_level"])
    total = F.aggregate(risk, F.lit(0), lambda a, v: a + v)
    keys = F.transform("events", lambda e: e["rule"])
    return context.select(
        "date",
        F.size("events").cast("double").alias("chain_active_count"),
        F.coalesce(F.array_max(risk), F.lit(0)).cast("double").alias("chain_max_risk_level"),
        F.when(F.size("events") > 0, total / F.nullif(F.size("events"), F.lit(0))).otherwise(0.0).alias("chain_avg_risk_level"),
        *[F.array_contains(keys, r[0]).cast("double").alias(f"chain_{r[0]}") for r in RULES],
    )


def ticker_sectors(ticker: Column, members: dict[str, list[str]] | None = None) -> Column:
    """Sector proxies that list the ticker, plus the ticker itself."""
    table = members if members is not None else SECTOR_MEMBERS
    own = F.upper(ticker)
    by_ticker: dict[str, list[str]] = {}
    for sector, names in table.items():
        for name in names:
            by_ticker.setdefault(name.upper(), []).append(sector)
    lookup = F.create_map(*[x for t, s in by_ticker.items() for x in (F.lit(t), F.array(*[F.lit(v) for v in s]))])
    return F.concat(F.coalesce(F.try_element_at(lookup, own), F.array().cast("array<string>")), F.array(own))


def exposure(sectors: Column, events: Column) -> Column:
    """Struct (net, positive, negative, rules) of a ticker's sector set against the events."""
    weight = lambda e: (e["risk_level"] + 1) / 4.0
    side = lambda name: F.aggregate(
        F.filter(events, lambda e: F.arrays_overlap(sectors, e[name])), F.lit(0.0), lambda a, e: a + weight(e)
    )
    pos, neg = side("positive"), side("negative")
    rules = F.transform(
        F.filter(events, lambda e: F.arrays_overlap(sectors, e["positive"]) | F.arrays_overlap(sectors, e["negative"])), lambda e: e["rule"]
    )
    net = F.when(pos + neg > 0, (pos - neg) / F.nullif(pos + neg, F.lit(0.0))).otherwise(0.0)
    return F.struct(
        F.round(net, 4).alias("net_exposure"), F.round(pos, 4).alias("positive_exposure"), F.round(neg, 4).alias("negative_exposure"), rules.alias("active_rules")
    )


def risk_flags(sectors: Column, events: Column, limit: int = 5) -> Column:
    """First-order texts of negative hits (risk >= 1), then second-order texts of risk >= 2; first ``limit``."""
    hurt = F.filter(events, lambda e: (e["risk_level"] >= 1) & F.arrays_overlap(sectors, e["negative"]))
    severe = F.filter(events, lambda e: e["risk_level"] >= 2)
    texts = F.concat(F.transform(hurt, lambda e: e["flag"]), F.transform(severe, lambda e: e["second_order"]))
    return F.slice(texts, 1, limit)


def signed(x: Column, places: int) -> Column:
    """Number with an explicit sign."""
    return F.format_string(f"%+.{places}f", x)


def context_adjustment(score: Column, net: Column, regime: Column, vix: Column, stress: Column, limit: float = 0.25) -> tuple[Column, Column]:
    """(adjusted score, reasons) from regime bias, sector exposure, VIX damping and commodity stress."""
    bias = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in REGIME_BIAS.items() for v in kv]), regime), F.lit(0.0))
    exp_adj = F.when(F.abs(net) > 0.2, net * 0.10).otherwise(0.0)
    first = bias + exp_adj
    damped = F.when(vix > 28, (score + first) * 0.85 - score).otherwise(first)
    stress_adj = F.when(stress > 0.5, -0.04 * stress).otherwise(0.0)
    total = clip(damped + stress_adj, -limit, limit)
    reasons = F.array_compact(
        F.array(
            F.when(bias != 0, F.concat(F.lit("Macro regime ("), regime, F.lit("): "), signed(bias, 2))),
            F.when(F.abs(net) > 0.2, F.concat(F.lit("Sector transmission exposure: "), signed(exp_adj, 2))),
            F.when(vix > 28, F.concat(F.lit("VIX dampening ("), F.format_string("%.0f", vix), F.lit("): signal ×85%"))),
            F.when(stress > 0.5, F.concat(F.lit("Commodity stress ("), F.format_string("%.2f", stress), F.lit("): "), signed(stress_adj, 2))),
        )
    )
    return F.round(clip(score + total, -1.0, 1.0), 6), reasons
