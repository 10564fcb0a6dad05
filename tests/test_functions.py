from pyspark.sql import functions as F

from opinara import config
from opinara.functions import text as tx
from opinara.functions import values as vl
from opinara.operators.summary import top_sentences


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()[0]


def test_cleaning(spark):
    dirty = "Hi @bob mail a.b@c.org call +91 98765 43210 see https://x.org/y \U0001f600 \U0001f680 Nice app!"
    got = one(spark, dirty, tx.strip_details(F.col("t")))
    assert "@" not in got and "https" not in got and "98765" not in got and got.endswith("Nice app!")
    assert one(spark, None, tx.strip_details(F.col("t"))) == ""
    assert one(spark, "<b>it’s</b> “ok”", tx.strip_markup(F.col("t"))) == "it's \"ok\""


def test_words_and_keywords(spark):
    assert one(spark, "Good app", tx.meaningful_words(F.col("t"))) == 2
    assert one(spark, "Smart Shuffle is bad", tx.contains_any(F.col("t"), config.PRIORITY_KEYWORDS)) is True
    assert one(spark, None, tx.meaningful_words(F.col("t"))) == 0
    assert one(spark, "a b", tx.shingles(F.col("t"))) == []
    assert one(spark, "ab cd", tx.shingles(F.col("t"))) == ["abc", "bcd"]


def test_locations(spark):
    assert one(spark, "I live in Mumbai, Maharashtra", tx.location_one(F.col("t"))) == "Mumbai"
    assert one(spark, "from New Delhi", tx.location_one(F.col("t"))) == "Delhi NCR"
    assert one(spark, "nothing here, goat", tx.location_one(F.col("t"))) is None
    assert len(config.REGIONS) + len(config.CITIES) == 99


def test_devices_and_paths(spark):
    for text, want in [("in my car", "car"), ("on the smart TV", "tv"), ("my iPad", "tablet"), ("my laptop", "pc"), ("galaxy watch", "wearable"), ("phone", "mobile")]:
        assert one(spark, text, tx.device(F.col("t"))) == want
    assert one(spark, "this is bad", tx.discovery_path(F.col("t"))) == "unrelated_ads"
    assert one(spark, "the shuffle", tx.discovery_path(F.col("t"))) == "discovery"


def test_slug_and_numbers(spark):
    for name, want in [("AI DJ", "ai_dj"), ("Podcasts & Audio", "podcasts_audio"), ("  Shuffle-Loops  ", "shuffle_loops")]:
        assert one(spark, name, tx.slug(F.col("t"))) == want
    assert one(spark, "2026-06-30", vl.end_of_day(F.col("t"))) == "2026-07-01"
    assert one(spark, "2026-06-30T01:00", vl.end_of_day(F.col("t"))) == "2026-06-30T01:00"
    assert one(spark, "junk", vl.end_of_day(F.col("t"))) == "junk"
    assert one(spark, "9", vl.clamp_rating(F.col("t").cast("int"))) == 5
    assert one(spark, '{"upvotes": 9}', F.round(vl.engagement(F.lit("reddit"), F.col("t")), 4)) == round(1.5 * (1 + 2.302585093), 4)
    assert one(spark, "broken{", vl.engagement(F.lit("reddit"), F.col("t"))) == 1.0
    assert [one(spark, n, vl.adaptive_threshold(F.col("t").cast("int"))) for n in ("100", "500", "9000")] == [0.80, 0.75, 0.60]


def test_summary():
    text = "The shuffle is broken. The shuffle repeats songs. I like cats. The shuffle repeats the same songs. Dogs bark. The shuffle is bad."
    got = top_sentences(text)
    assert got.count(".") == 3 and "shuffle" in got
    assert top_sentences("One. Two.") == "One. Two."
    assert top_sentences("") == ""
