"""Mixed timestamp notations to one UTC instant.

Every value becomes an array of all its valid readings (format, instant, prior).  A Viterbi pass over each source's
record order picks one reading per value: changing the format or stepping back in time costs ``SWITCH_COST`` /
``BACK_COST``, a reading against a stated convention (day/month order of the locale, earlier instant of a repeated
wall time, unit of bare digits) costs ``RULE_COST``, which outweighs any run of neighbours, so that the order
decides where the conventions leave a choice: dates with slashes of a country that has no row among the locales may
be day or month first at the same cost.

A source may hold any share of all rows.  Its record order is therefore cut into blocks, ranges of the record id of
about ``BLOCK_ROWS`` rows at every size.  Each block is reduced to its min-plus transfer matrix between first and last reading, the matrices are chained
(one small row per block), and every block is then solved between its fixed ends.  The result equals one Viterbi
pass over the whole source.

Defined results: null, blank and unreadable values, impossible dates and unknown zone names give no row; equal ids
keep one row each; columns beside the named ones are ignored.
"""

from __future__ import annotations

from zoneinfo import available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.runtime import written

SWITCH_COST, BACK_COST, RULE_COST = 1.0, 1.0, 1000.0
READINGS = 4
BLOCK_ROWS = 50_000  # values of all fields and sources in a block

_ZONE = r"(Z|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?(?:\[[\w/+\-]+\])?|\[[\w/+\-]+\]|[A-Za-z_]+(?:/[\w+\-]+)+|[A-Za-z]{1,5})?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
# name -> (pattern, replacement giving: year | month | day | hour | minute | second | fraction | am/pm | zone)
NOTATIONS = {
    "iso": (rf"(?i)^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[T ]\s*{_TIME}\s*{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    "compact": (rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})?\s*{_ZONE}$", "$1|$2|$3|$4|$5|$6|||$7"),
    "day_month_name": (
        rf"(?i)^(?:[a-z]{{3,9}},?\s+)?(\d{{1,2}})[ -]([a-z]{{3,9}})\.?,?[ -](\d{{4}})(?:,?\s+(?:at\s+)?{_TIME}\s*(AM|PM)?\s*{_ZONE})?$",
        "$3|$2|$1|$4|$5|$6|$7|$8|$9",
    ),
    "month_name_day": (
        rf"(?i)^(?:[a-z]{{3,9}},\s+)?([a-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_TIME}\s*(AM|PM)?\s*{_ZONE})?$",
        "$3|$1|$2|$4|$5|$6|$7|$8|$9",
    ),
    "slash": (rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+(?:at\s+)?{_TIME}\s*(AM|PM)?\s*{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "dot": (rf"(?i)^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s+(?:at\s+)?{_TIME}\s*(AM|PM)?\s*{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
_ORDER = "case when a.prior < b.prior then -1 when a.prior > b.prior then 1 when a.micros < b.micros then -1 when a.micros > b.micros then 1 else 0 end"
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_FIRST_MICROS, _LAST_MICROS = 631_152_000_000_000, 4_102_444_800_000_000  # 1990 and 2100: range of a plausible other unit


def folded_name(c: Column) -> Column:
    """A source or country name without outer blanks, case and the difference of ``-`` and ``_``; blank becomes null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), "-", "_"), F.lit(""))


def computed(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns through a generator, so that their expressions are evaluated once and not copied into every use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def _bounded_rows(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a lookup table with more than {most} rows")
    return rows


def readings(values: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """Add ``readings array<struct<fmt,micros,prior>>`` to rows of (value, local_zone, month_first).

    ``local_zone`` is the zone of a text without its own, ``month_first`` the order of dates with slashes, null if no
    convention states it.
    """
    offsets = {r["abbreviation"].upper(): int(r["utc_offset_minutes"]) for r in _bounded_rows(abbreviations, 1000) if r["abbreviation"] and r["utc_offset_minutes"] is not None}
    offset_map = F.create_map(*[F.lit(x) for kv in (offsets or {"UTC": 0}).items() for x in kv])
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for name in {m, m[:3], m[:4] if m == "september" else m} for x in (name, i + 1)])

    text = F.trim(F.regexp_replace("value", r"[\s   ]+", " "))
    form = F.split(F.coalesce(*[F.when(F.col("_v").rlike(p), F.concat(F.lit(name + "|"), F.regexp_replace("_v", p, to))) for name, (p, to) in NOTATIONS.items()]), r"\|")
    df = computed(computed(values, _v=text), _p=form)
    part = lambda i: F.nullif(F.get("_p", F.lit(i)), F.lit(""))
    fmt = part(0)
    month_name = F.try_element_at(months, F.lower(part(2)))
    month = F.coalesce(F.expr("try_cast(_p[2] as int)"), month_name)
    hour = F.expr("try_cast(nullif(_p[4], '') as int)")
    half = F.upper(part(8))
    hour = F.when(half.isNull(), F.coalesce(hour, F.lit(0))).when(hour.between(1, 12), hour % 12 + F.when(half == "PM", 12).otherwise(0))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat(two(hour), F.lit(":"), F.coalesce(part(5), F.lit("00")), F.lit(":"), F.coalesce(part(6), F.lit("00")), F.lit("."), F.rpad(F.substring(F.coalesce(part(7), F.lit("0")), 1, 6), 6, "0"))
    day = F.expr("try_cast(_p[3] as int)")
    zone = F.regexp_replace(part(9), r"^\[|\]$", "")
    zone_text, zone = zone, F.col("_zone_text")
    plain_offset = F.regexp_extract(F.upper(zone), r"^(?:UTC|GMT)?([+-]\d{1,2}(?::?\d{2})?)", 1)
    digits = F.regexp_replace(F.substring(plain_offset, 2, 9), ":", "")
    digits = F.rpad(F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits), 4, "0")
    sign = F.when(plain_offset.startswith("-"), -1).otherwise(1)
    minutes = F.when(plain_offset != "", sign * (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")))
    minutes = F.coalesce(minutes, F.when(F.upper(zone).isin("Z", "UTC", "GMT"), 0), F.try_element_at(offset_map, F.upper(zone)))
    region = F.when(zone.isin(*sorted(z for z in available_timezones() if "/" in z)), zone)
    df = computed(df, _year=part(1), _month=two(month), _day=two(day), _clock=clock, _zone_text=zone_text, _fmt=fmt)
    df = computed(df, _minutes=minutes, _region=region)
    df = computed(
        df,
        _zone=F.when(F.col("_minutes").isNull(), F.coalesce("_region", F.when(zone.isNull(), F.col("local_zone")))),
        _wall_a=F.expr("try_cast(concat(_year, '-', _month, '-', _day, ' ', _clock) as timestamp_ntz)"),
        _wall_b=F.expr("if(_fmt in ('slash', 'dot') and _month <> _day, try_cast(concat(_year, '-', _day, '-', _month, ' ', _clock) as timestamp_ntz), null)"),
    )
    micros = lambda ntz: f"timestampdiff(MICROSECOND, {_EPOCH}, {ntz})"
    found = []
    for wall, name, rule in (
        ("_wall_a", "_fmt", f"if(_fmt = 'slash' and coalesce(month_first, false), {RULE_COST}, 0D)"),
        ("_wall_b", "concat(_fmt, '_month_first')", f"if(_fmt = 'slash' and coalesce(month_first, true), 0D, {RULE_COST})"),
    ):
        early = f"convert_timezone(_zone, 'UTC', {wall})"
        late = f"{early} + interval 1 hour"
        found += [
            f"if(_minutes is not null and {wall} is not null, named_struct('fmt', {name}, 'micros', {micros(wall)} - _minutes * 60000000L, 'prior', {rule}), null)",
            f"if(_zone is not null and {wall} is not null, named_struct('fmt', {name}, 'micros', {micros(early)}, 'prior', {rule}), null)",
            f"if(_zone is not null and {wall} is not null and _zone <> 'UTC' and convert_timezone('UTC', _zone, {late}) = {wall}, named_struct('fmt', {name}, 'micros', {micros(late)}, 'prior', {rule} + {RULE_COST}), null)",
        ]
    number = "try_cast(if(_v rlike '^[0-9]{1,17}$', _v, null) as bigint)"
    for unit, low, high, factor in (("seconds", 1, 11, "* 1000000L"), ("millis", 12, 14, "* 1000L"), ("micros", 15, 17, "* 1L")):
        value = f"try_multiply({number}, {factor[2:]})"
        usual = f"length(_v) between {low} and {high}"
        found.append(f"if({number} is not null and ({usual} or {value} between {_FIRST_MICROS} and {_LAST_MICROS}), named_struct('fmt', '{unit}', 'micros', {value}, 'prior', if({usual}, 0D, {RULE_COST})), null)")
    df = computed(df, readings=F.expr(f"filter(array({', '.join(found)}), x -> x.micros is not null)"))
    return df.select(*values.columns, "readings")


def _states(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fmt = np.stack([pdf[f"f{k}"].fillna(-1).to_numpy(np.int64) for k in range(READINGS)], 1)
    at = np.stack([pdf[f"m{k}"].fillna(0).to_numpy(np.int64) for k in range(READINGS)], 1)
    prior = np.stack([pdf[f"p{k}"].fillna(np.inf).to_numpy(float) for k in range(READINGS)], 1)
    return fmt, at, prior


def _steps(f0: np.ndarray, m0: np.ndarray, f1: np.ndarray, m1: np.ndarray) -> np.ndarray:
    return SWITCH_COST * (f0[:, None] != f1[None, :]) + BACK_COST * (m1[None, :] < m0[:, None])


def _transfer(fmt: np.ndarray, at: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Cost from each reading of the first record to each of the last, priors of both included."""
    cost = np.full((READINGS, READINGS), np.inf)
    np.fill_diagonal(cost, prior[0])
    for i in range(1, len(fmt)):
        cost = (cost[:, :, None] + _steps(fmt[i - 1], at[i - 1], fmt[i], at[i])[None]).min(1) + prior[i]
    return cost


def _summary(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["record_id", "value"], kind="stable")
    fmt, at, prior = _states(pdf)
    single = np.flatnonzero(np.isinf(prior[:, 1]))
    if len(single):  # a record with one reading parts the chain: only the two ends matter, up to a constant
        a, b = single[0] + 1, single[-1]
        cost = _transfer(fmt[:a], at[:a], prior[:a]).min(1)[:, None] + _transfer(fmt[b:], at[b:], prior[b:])[0][None, :]
        if len(fmt) == 1:
            cost = _transfer(fmt, at, prior)
    else:
        cost = _transfer(fmt, at, prior)
    row = pdf.iloc[[0]][["field_name", "source_key", "block"]].copy()
    row["cost"] = [cost.ravel().tolist()]
    for name, x, i in (("first_fmt", fmt, 0), ("first_at", at, 0), ("last_fmt", fmt, -1), ("last_at", at, -1)):
        row[name] = [x[i].tolist()]
    return row


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Choose first and last reading of every block of one source."""
    pdf = pdf.sort_values("block")
    arr = {c: [np.asarray(x) for x in pdf[c]] for c in ("cost", "first_fmt", "first_at", "last_fmt", "last_at")}
    total, back = None, []
    for i in range(len(pdf)):
        cost = arr["cost"][i].reshape(READINGS, READINGS)
        if total is None:
            through = cost  # entry is the first reading itself
            came = np.full(READINGS, -1)
        else:
            enter = total[:, None] + _steps(arr["last_fmt"][i - 1], arr["last_at"][i - 1], arr["first_fmt"][i], arr["first_at"][i])
            came = enter.argmin(0)
            through = enter.min(0)[:, None] + cost
        back.append((came, through.argmin(0)))
        total = through.min(0)
        total = total - total.min()
    last, out = int(np.argmin(total)), []
    for came, first_of in reversed(back):
        first = int(first_of[last])
        out.append((first, last))
        last = int(came[first])
    pdf["first_choice"], pdf["last_choice"] = zip(*reversed(out))
    return pdf[["field_name", "source_key", "block", "first_choice", "last_choice"]]


def _solve(pdf: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["record_id", "value"], kind="stable")
    fmt, at, prior = _states(pdf)
    n = len(pdf)
    pick = np.zeros(n, np.int64)
    fixed = np.isinf(prior[:, 1])
    if n and len(ends):
        fixed[0] = fixed[-1] = True
        pick[-1] = ends["last_choice"].iloc[0]
        if n > 1:
            pick[0] = ends["first_choice"].iloc[0]
    anchors = np.flatnonzero(fixed)
    for a, b in zip(anchors[:-1], anchors[1:]):
        if b == a + 1:
            continue
        cost = np.where(np.arange(READINGS) == pick[a], 0.0, np.inf)
        back = []
        for i in range(a + 1, b + 1):
            through = cost[:, None] + _steps(fmt[i - 1], at[i - 1], fmt[i], at[i])
            back.append(through.argmin(0))
            cost = through.min(0) + prior[i]
        k = pick[b]
        for i in range(b, a + 1, -1):
            k = back[i - a - 1][k]
            pick[i - 1] = k
    take = np.arange(n)
    return pd.DataFrame({"landing_id": pdf["record_id"].to_numpy(), "field_name": pdf["field_name"].to_numpy(), "value": pdf["value"].to_numpy(), "utc_micros": at[take, pick], "fmt": fmt[take, pick], "n_readings": np.isfinite(prior).sum(1)})


def normalise_timestamps(rows: DataFrame, locales: DataFrame, abbreviations: DataFrame, *, id_col: str = "landing_id", local_fields: tuple[str, ...] = ("published_at",), utc_fields: tuple[str, ...] = ("scraped_at", "created_at"), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row (landing_id, field_name, value, utc_micros, notation, n_readings) per readable value.

    Values of ``local_fields`` without zone are wall time of the row's source and country; values of ``utc_fields``
    are UTC.  ``rows`` needs ``id_col``, ``source``, ``country`` and the fields.
    """
    fields = (*local_fields, *utc_fields)
    places = locales.select(folded_name(F.col("source_name")).alias("source_key"), folded_name(F.col("country_code")).alias("country_key"), F.col("zone_name"), (F.lower("date_order") == "mdy").alias("mdy")).dropDuplicates(["source_key", "country_key"])
    base = rows.select(F.col(id_col).alias("record_id"), folded_name(F.col("source")).alias("source_key"), folded_name(F.col("country")).alias("country_key"), *fields)
    # blocks: ranges of the record id, cut before any work on the values so that sampling the ranges reads ids only
    n_blocks = max(1, -(-len(fields) * rows.count() // block_rows))
    base = base.repartitionByRange(n_blocks, "record_id").withColumn("block", F.spark_partition_id())
    melted = base.join(places, ["source_key", "country_key"], "left").select(
        "record_id", "block", F.coalesce("source_key", F.lit("")).alias("source_key"), "zone_name", F.when(F.col("country_key").isNull(), False).otherwise(F.col("mdy")).alias("mdy"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("x"),
    ).select("record_id", "block", "source_key", "zone_name", "mdy", "x.field_name", "x.value").where(F.length(F.trim("value")) > 0)
    local = F.col("field_name").isin(*local_fields)
    values = melted.select("record_id", "block", "source_key", "field_name", "value", F.when(local, F.coalesce("zone_name", F.lit("UTC"))).otherwise(F.lit("UTC")).alias("local_zone"), F.col("mdy").alias("month_first"))
    read = readings(values, abbreviations).where(F.size("readings") > 0)

    names = sorted({n + tail for n in NOTATIONS for tail in ("", "_month_first")} | {"seconds", "millis", "micros"})
    code = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    flat = computed(read.withColumnRenamed("readings", "_r"), readings=F.expr("array_sort(_r, (a, b) -> " + _ORDER + ")"))
    one = lambda k: F.get("readings", F.lit(k))
    flat = flat.select(
        "record_id", "source_key", "field_name", "value", "block",
        *[c for k in range(READINGS) for c in (code[one(k)["fmt"]].alias(f"f{k}"), one(k)["micros"].alias(f"m{k}"), one(k)["prior"].alias(f"p{k}"))],
    )
    flat = written(flat, "readings")  # fixes the blocks
    keys = ["field_name", "source_key", "block"]
    kind = dict(flat.dtypes)
    summary = flat.groupBy(*keys).applyInPandas(lambda pdf: _summary(pdf), f"field_name string, source_key string, block int, cost array<double>, first_fmt array<bigint>, first_at array<bigint>, last_fmt array<bigint>, last_at array<bigint>")
    ends = summary.groupBy("field_name", "source_key").applyInPandas(lambda pdf: _chain(pdf), "field_name string, source_key string, block int, first_choice int, last_choice int")
    solved = flat.groupBy(*keys).cogroup(ends.groupBy(*keys)).applyInPandas(lambda pdf, e: _solve(pdf, e), f"landing_id {kind['record_id']}, field_name string, value string, utc_micros bigint, fmt bigint, n_readings int")
    return solved.select("landing_id", "field_name", "value", "utc_micros", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("fmt") + 1).cast("int")).alias("notation"), "n_readings")
