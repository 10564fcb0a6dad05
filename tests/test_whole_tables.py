import datetime
import hashlib
import re

from opinara import config
from opinara.plans.review_queries import FROM, QUERIES, TO

TEXTS = [
    "plain words for the app", "", None, "ab", "line one\nline two\tend", "Größe der Straße an käthe@müller.de schicken", "गाड़ी चलाते समय गाना ९८७६५ ४३२१० रुक जाता है",
    "பாடல் நின்று விடுகிறது", "call 98765 43210 now", "see https://x.org/a　then“quoted” \U0001f600\U0001f680 ok", "গান থেমে যায় u/some_one @who", "a b c\x85d", "mail a.b@c.org or +91 98765 43210",
]
DATES = ["2026-03-01", "2026-05-31T10:00", "2026-06-01", "2025-12-31 08:00:00", "01.01.2026 00:39", "1756704111", "1756844222061", "Fri, 01 May 2026 00:09:51 +0100", None, "", "junk", "2026-13-40", "2026-3-9"]


def _strip(t):
    for p in (r"[\w.\-]+@[\w.\-]+\.\w+", r"\+?\d{1,4}[-.\s]?\(?\d{1,3}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}", r"https?://\S+|www\.\S+", r"@[a-zA-Z0-9_]+|u/[a-zA-Z0-9_-]+", "[\U00010000-\U0010ffff]+"):
        t = re.sub(p, "", t)
    return re.sub(r"\s+", " ", t).strip()


def _words(t):
    return sum(w not in config.LENGTH_STOP_WORDS for w in re.findall(r"\w+", t.lower()))


def _shingles(t):
    f = re.sub(r"\s+", "", t.lower())
    sh = {f[i : i + 3] for i in range(len(f) - 2)}
    return (len(sh), hashlib.md5(" ".join(sorted(sh)).encode()).hexdigest()) if sh else None


def _end(d):
    try:
        return d if d is None or len(d) > 10 else (datetime.datetime.strptime(d, "%Y-%m-%d") + datetime.timedelta(days=1)).strftime("%Y-%m-%d")
    except ValueError:
        return d


def _inside(d):
    try:
        return FROM <= str(datetime.date.fromisoformat(d[:10])) <= TO
    except (TypeError, ValueError):
        return True


def test_queries_answer_every_row(spark, tmp_path):
    rows = [(i, t, DATES[i], i - 3 if i % 4 else None) for i, t in enumerate(TEXTS)]
    assert len(TEXTS) == len(DATES)
    spark.createDataFrame(rows, "landing_id bigint, raw_text string, published_at string, rating int").write.parquet(f"{tmp_path}/reviews.parquet")
    got = lambda name: {r[0]: tuple(r)[1:] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("txt_strip_pii") == {i: (hashlib.md5(_strip(t or "").encode()).hexdigest(),) for i, t, *_ in rows}
    assert got("txt_meaningful_words") == {i: (_words(t or ""),) for i, t, *_ in rows}
    assert got("txt_shingles") == {i: x for i, t, *_ in rows if (x := _shingles(t or ""))}
    assert got("num_rating_and_end") == {i: (None if r is None else max(1, min(5, r)), _end(d)) for i, _, d, r in rows}
    inside = sum(map(_inside, DATES))
    assert got("flt_date_window") == {inside: (len(DATES) - inside, inside < len(DATES))}
