"""Financial phrase lexicon.

Fixed values: phrase weights, combination bonuses and negation words.  They are
defaults; every lexicon operator takes its own tables.
"""

from __future__ import annotations

# Bullish phrases and their weights (fixed values).
BULLISH = {
    "beat expectations": 3, "earnings beat": 3, "revenue growth": 3, "record profits": 4, "record revenue": 4,
    "strong guidance": 3, "raised outlook": 4, "raised guidance": 4, "raises guidance": 4, "margin expansion": 3,
    "accelerating growth": 3, "record earnings": 4, "exceeded expectations": 3, "above expectations": 3,
    "topped estimates": 3, "blowout earnings": 5, "profit surge": 3, "strategic partnership": 2, "major contract": 3,
    "market expansion": 2, "new product launch": 2, "acquisition synergy": 2, "market share gains": 3,
    "scaling operations": 2, "major deal": 2, "landmark deal": 3, "exclusive contract": 3, "signed agreement": 2,
    "share buyback": 3, "stock buyback": 3, "buyback program": 3, "dividend increase": 3, "dividend hike": 3,
    "special dividend": 3, "insider buying": 2, "institutional buying": 2, "strong demand": 2, "oversubscribed": 3,
    "government approval": 3, "regulatory approval": 4, "fda approval": 4, "regulatory clearance": 3,
    "tax incentives": 2, "policy support": 2, "subsidies": 2, "approved": 2, "breakthrough": 4,
    "first of its kind": 5, "patent approval": 4, "blockbuster": 4, "transformative": 3, "game changer": 4,
    "game-changing": 4, "revolutionary": 3, "surges": 2, "surged": 2, "surge": 2, "soars": 3, "soared": 3, "soar": 3,
    "jumps": 2, "jumped": 2, "jump": 2, "rallies": 2, "rallied": 2, "rally": 2, "climbs": 2, "climbed": 2,
    "skyrockets": 3, "skyrocketed": 3, "outperforms": 2, "outperformed": 2, "outperforming": 2, "beats": 2, "beat": 2,
    "raises price target": 3, "raised price target": 3, "raises pt": 2, "raised pt": 2, "price target raised": 3,
    "price target raise": 3, "target on": 2, "raises target": 3, "raised target": 3, "upgrades": 2, "upgraded": 2,
    "upgrade": 2, "initiates with buy": 3, "initiated with buy": 3, "strong buy": 3, "outperform rating": 2,
    "overweight rating": 2, "overweight": 2, "buy rating": 2, "reiterate buy": 2, "reiterates buy": 2,
    "price target increase": 2, "target raised": 2, "upped target": 2, "boosts target": 2, "raises dividend": 3,
    "raised dividend": 3, "dividend raised": 3, "raised its dividend": 3, "raises its dividend": 3, "buyback": 2,
    "repurchase": 2, "ipo": 2, "goes public": 2, "massive investment": 2, "committed": 2, "record high": 3,
    "all time high": 3, "all-time high": 3, "profit rises": 3, "earnings rise": 3, "revenue rises": 3,
    "strong results": 3, "strong earnings": 3, "earnings growth": 3, "profit growth": 3, "strong quarter": 3,
    "solid quarter": 2, "beats estimates": 3, "topped forecasts": 3, "doubles down": 2, "expands": 1,
    "accelerates": 2, "acceleration": 2, "demand surge": 3, "boom": 2, "milestone": 2, "record quarter": 4,
    "best ever": 4, "best quarter": 4,
}

# Bearish phrases and their weights (fixed values).
BEARISH = {
    "missed expectations": -3, "missed estimates": -3, "below expectations": -3, "earnings miss": -3,
    "revenue decline": -3, "profit warning": -4, "lower guidance": -4, "cuts guidance": -4, "reduced outlook": -4,
    "margin pressure": -3, "earnings shortfall": -4, "weak guidance": -3, "disappointing results": -3,
    "missed revenue": -3, "debt concerns": -3, "liquidity issues": -4, "credit downgrade": -4, "cash burn": -3,
    "covenant breach": -5, "going concern": -5, "default risk": -5, "debt crisis": -4, "credit crisis": -4,
    "rating downgrade": -4, "rating downgraded": -3, "sec investigation": -5, "sec probe": -5,
    "antitrust lawsuit": -4, "regulatory fine": -3, "compliance violation": -3, "class action": -4,
    "fraud investigation": -5, "accounting fraud": -5, "restatement": -5, "securities fraud": -5,
    "under investigation": -4, "investigated": -3, "lawsuit": -2, "fined": -3, "penalty": -2, "layoffs": -3,
    "workforce reduction": -3, "job cuts": -3, "demand slowdown": -3, "supply chain disruption": -3,
    "customer losses": -3, "losing market share": -4, "declining sales": -3, "revenue miss": -3, "plant closure": -3,
    "store closures": -2, "restructuring charges": -2, "bankruptcy": -5, "chapter 11": -5, "delisting": -5,
    "delisted": -5, "accounting irregularities": -5, "ponzi": -5, "fraud": -4, "recall": -3, "product recall": -4,
    "suspended": -3, "tumbles": -3, "tumbled": -3, "tumble": -3, "plummets": -3, "plummeted": -3, "plummet": -3,
    "plunges": -3, "plunged": -3, "plunge": -3, "dives": -3, "dived": -3, "dive": -3, "sinks": -2, "sank": -2,
    "sink": -2, "sinking": -2, "slumps": -3, "slumped": -3, "slump": -3, "crashes": -4, "crashed": -4, "crash": -4,
    "drops": -2, "dropped": -2, "declines": -2, "declined": -2, "falls sharply": -3, "sharp decline": -3,
    "sells off": -2, "sell-off": -2, "selloff": -2, "rout": -3, "bloodbath": -4, "cuts price target": -3,
    "cut price target": -3, "cuts pt": -2, "cut pt": -2, "price target cut": -3, "price target reduced": -3,
    "downgrades": -2, "downgraded": -2, "downgrade": -2, "sell rating": -3, "underweight rating": -2,
    "underweight": -2, "underperform": -2, "avoid": -1, "reduce rating": -2, "slashes target": -3,
    "slashed target": -3, "bubble fears": -3, "bubble": -2, "fears": -1, "fear": -1, "worries": -2, "worry": -1,
    "concerns": -1, "concern": -1, "threatens": -2, "threaten": -2, "threatened": -2, "threatens to hurt": -3,
    "at risk": -2, "surging oil": -2, "surging costs": -2, "surging inflation": -2, "risks": -1, "warning": -2,
    "warns": -2, "disappoints": -3, "disappointing": -2, "struggles": -2, "struggling": -2, "pressure": -1,
    "headwinds": -2, "headwind": -2, "uncertainty": -1, "volatile": -1, "volatility": -1, "mass layoffs": -4,
    "announces layoffs": -3, "cuts jobs": -3, "cutting jobs": -3, "workforce cut": -3, "job losses": -3,
    "plant shutdown": -3, "factory closure": -3,
}

# Neutral phrases (fixed values).
NEUTRAL = {
    "in line with expectations": 0, "meets expectations": 0, "maintains guidance": 0, "stable demand": 0,
    "operational update": 0, "strategic review": 0, "reorganisation": 0, "reorganization": 0,
    "executive transition": 0, "board appointment": 0, "as expected": 0, "in line with": 0,
}

# All listed texts present -> bonus and its description (fixed values).
COMBINATIONS = [
    (["earnings beat", "raised guidance"], 3.0, "beat+raised guidance"),
    (["earnings beat", "record revenue"], 2.0, "beat+record revenue"),
    (["raised guidance", "record"], 1.5, "raised guidance+record"),
    (["profit warning", "lower guidance"], -3.0, "warning+lower guidance"),
    (["missed expectations", "cuts guidance"], -3.0, "miss+cuts guidance"),
    (["sec investigation", "accounting fraud"], -3.0, "sec+fraud"),
    (["layoffs", "lower guidance"], -2.0, "layoffs+lower guidance"),
    (["buyback", "dividend"], 2.0, "buyback+dividend"),
    (["beats", "raised guidance"], 3.0, "beats+raised guidance"),
    (["record", "raised guidance"], 2.0, "record+raised guidance"),
    (["upgraded", "raises price target"], 2.0, "upgrade+target raise"),
    (["downgraded", "cuts price target"], -2.0, "downgrade+target cut"),
    (["tumbles", "profit warning"], -2.0, "tumbles+profit warning"),
    (["plummets", "lower guidance"], -2.0, "plummets+lower guidance"),
    (["bubble", "fears"], -1.5, "bubble+fears"),
    (["layoffs", "revenue decline"], -2.0, "layoffs+revenue decline"),
    (["buyback", "record"], 2.0, "buyback+record"),
    (["dividend", "record"], 1.5, "dividend+record"),
]

NEGATION_WORDS = ["not", "no", "never", "fails", "failed", "unable", "without", "disappoints"]
NEGATION_WINDOW = 3
NEGATION_FACTOR = -0.8
