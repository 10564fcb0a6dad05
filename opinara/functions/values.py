"""Numbers, dates and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara import config


def engagement(source: Column, metadata: Column) -> Column:
    """1 + ln(1 + endorsements) by source, posts of threads 1.5 times; no metadata or an unknown source gives 1."""
    number = lambda *keys: F.greatest(F.lit(0.0), F.coalesce(*[F.get_json_object(metadata, f"$.{k}").try_cast("double") for k in keys], F.lit(0.0)))
    log = lambda c: 1.0 + F.log1p(c)
    post = F.when(F.coalesce(F.get_json_object(metadata, "$.is_post"), F.lit("true")) == "false", 1.0).otherwise(1.5)
    known = (
        F.when(source.isin("google_play", "app_store"), log(number("thumbs_up_count", "thumbsUpCount")))
        .when(source == "youtube", log(number("like_count", "likeCount")))
        .when(source == "reddit", post * log(number("upvotes", "score")))
        .when(source == "community_forum", log(number("kudos_count", "kudos")))
    )
    return F.coalesce(F.when(F.get_json_object(metadata, "$").isNotNull(), known), F.lit(1.0))


def clamp_rating(c: Column) -> Column:
    """Between 1 and 5; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), c.cast("int"))))


def parsed_time(c: Column, now: Column) -> Column:
    """A text date as timestamp; unreadable gives ``now``, without zone UTC."""
    return F.coalesce(F.try_to_timestamp(c), now)


def end_of_day(c: Column) -> Column:
    """A bare date becomes the next day; longer or unreadable texts stay."""
    day = F.when(c.rlike(r"^\d{4}-\d\d?-\d\d?\z"), c.try_cast("date"))
    return F.when(F.length(c) > 10, c).otherwise(F.coalesce(F.date_add(day, 1).cast("string"), c))


def within_horizon(at: Column, now: Column, days: int = config.HORIZON_DAYS) -> Column:
    """Whole days of age at most ``days``; unreadable times are kept.  Times without zone are no instants: the caller
    keeps them (:func:`has_zone`)."""
    return F.coalesce(F.floor((now.cast("double") - at.cast("double")) / 86400) <= days, F.lit(True))


def has_zone(text: Column) -> Column:
    """Whether a text date names a zone or offset after its time."""
    return F.coalesce(text.rlike(r"\d{2}:\d{2}.*(?:[Zz]|[+-]\d{2}:?\d{2}(?::?\d{2})?)\s*$"), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """Divided by the norm where it is above zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def usable(a: Column, dimension: int) -> Column:
    """Of the wanted length, finite and not all zero; null gives false."""
    n = norm(a)
    return F.coalesce((F.size(a) == dimension) & (n > 0) & ~F.isnan(n) & (n < float("inf")), F.lit(False))


def adaptive_threshold(n: Column) -> Column:
    out = None
    for bound, t in config.ADAPTIVE_THRESHOLDS:
        out = F.when(n < bound, t) if out is None else out.when(n < bound, t)
    return out.otherwise(config.ADAPTIVE_FLOOR)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, 0 where the whole is 0."""
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


def opportunity(size: Column, total: Column, rating: Column, synergy: Column, churn: Column, premium: Column) -> Column:
    """severity x frequency x source synergy x impact, times 100; no reviews give 0."""
    severity = F.greatest(F.lit(0.1), F.least(F.lit(1.0), (5.0 - rating) / 4.0))
    return F.coalesce(severity * F.try_divide(size, total) * synergy * (1.0 + 0.5 * churn + 0.5 * premium) * 100.0, F.lit(0.0))


def decile(score: Column) -> Column:
    return F.least(F.lit(10), F.greatest(F.lit(1), (score / 10).cast("int") + 1))
