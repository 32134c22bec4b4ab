"""Table schemas shared by sources and operators."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


NEWS = _struct(
    ("date", T.TimestampType()),
    ("ticker", T.StringType()),
    ("headline", T.StringType()),
    ("source", T.StringType()),
)
SCORED = T.StructType(
    NEWS.fields
    + _struct(
        ("label_name", T.StringType()),
        ("confidence", T.DoubleType()),
        ("signal", T.IntegerType()),
    ).fields
)
SENTENCES = _struct(
    ("text", T.StringType()),
    ("label", T.IntegerType()),
    ("label_name", T.StringType()),
    ("source", T.StringType()),
)
SENTIMENT_CACHE = _struct(
    ("cache_key", T.StringType()),
    ("label_name", T.StringType()),
    ("confidence", T.DoubleType()),
    ("prob_negative", T.DoubleType()),
    ("prob_neutral", T.DoubleType()),
    ("prob_positive", T.DoubleType()),
)
PRICES = _struct(
    ("date", T.DateType()),
    ("ticker", T.StringType()),
    ("close", T.DoubleType()),
    ("volume", T.DoubleType()),
)
KEYWORD_SUMMARY = _struct(
    ("keyword", T.StringType()),
    ("event_count", T.LongType()),
    ("avg_CAR", T.DoubleType()),
    ("std_CAR", T.DoubleType()),
    ("positive_pct", T.DoubleType()),
    ("t_stat", T.DoubleType()),
    ("p_value", T.DoubleType()),
    ("signal_grade", T.StringType()),
    ("is_finance_phrase", T.BooleanType()),
)
RUN_STATE = _struct(
    ("stage", T.StringType()),
    ("status", T.StringType()),
    ("code", T.StringType()),
    ("message", T.StringType()),
    ("timestamp_utc", T.TimestampType()),
)
SERIES = _struct(
    ("series", T.StringType()),
    ("date", T.DateType()),
    ("value", T.DoubleType()),
)

# Landed article JSON of the news connectors.
FEED_JSON = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("pubDate", T.StringType()),
        T.StructField("displayTime", T.StringType()),
        T.StructField("providerPublishTime", T.LongType()),
        T.StructField(
            "content",
            _struct(
                ("title", T.StringType()),
                ("pubDate", T.StringType()),
                ("displayTime", T.StringType()),
            ),
        ),
    ]
)
GUARDIAN_JSON = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField(
            "response",
            T.StructType(
                [
                    T.StructField(
                        "results",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("webTitle", T.StringType()),
                                    T.StructField("webPublicationDate", T.StringType()),
                                    T.StructField("fields", _struct(("headline", T.StringType()))),
                                ]
                            )
                        ),
                    )
                ]
            ),
        ),
    ]
)
NYT_JSON = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField(
            "response",
            T.StructType(
                [
                    T.StructField(
                        "docs",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("headline", _struct(("main", T.StringType()))),
                                    T.StructField("pub_date", T.StringType()),
                                ]
                            )
                        ),
                    )
                ]
            ),
        ),
    ]
)
NEWSAPI_JSON = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField(
            "articles",
            T.ArrayType(_struct(("title", T.StringType()), ("publishedAt", T.StringType()))),
        ),
    ]
)
GDELT_JSON = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField(
            "articles",
            T.ArrayType(
                _struct(
                    ("title", T.StringType()),
                    ("seendate", T.StringType()),
                    ("url", T.StringType()),
                    ("domain", T.StringType()),
                )
            ),
        ),
    ]
)
FILINGS_JSON = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("item", T.StringType()),
        T.StructField(
            "hits",
            T.StructType(
                [
                    T.StructField(
                        "hits",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField(
                                        "_source",
                                        _struct(
                                            ("file_date", T.StringType()),
                                            ("period_of_report", T.StringType()),
                                            ("display_names", T.StringType()),
                                        ),
                                    )
                                ]
                            )
                        ),
                    )
                ]
            ),
        ),
    ]
)
FEED_ENTRY = _struct(
    ("title", T.StringType()),
    ("summary", T.StringType()),
    ("published", T.TimestampType()),
)
OBSERVATIONS_JSON = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField(
            "observations",
            T.ArrayType(_struct(("date", T.StringType()), ("value", T.StringType()))),
        ),
    ]
)
