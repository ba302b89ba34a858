"""Quantities recorded in different units: pay in one currency per year.

Everything is built-in SQL: ``regexp_extract`` takes figures and unit words out
of the text, small alias tables name the units, and the unit is the first known
of text, field and source default. Then factor (and offset, 0 for pay) apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings of currencies, scales and periods.
CURRENCY_ALIASES = {
    "₹": "INR", "rs": "INR", "inr": "INR", "rupees": "INR", "rupee": "INR", "lakh": "INR", "lakhs": "INR", "lac": "INR", "lacs": "INR", "lpa": "INR", "l": "INR",
    "crore": "INR", "crores": "INR", "cr": "INR", "us$": "USD", "$": "USD", "usd": "USD", "s$": "SGD", "sgd": "SGD", "£": "GBP", "gbp": "GBP", "€": "EUR", "eur": "EUR",
    "aed": "AED", "dhs": "AED", "dh": "AED",
}
SCALE_ALIASES = {"k": 1e3, "l": 1e5, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "lpa": 1e5, "cr": 1e7, "crore": 1e7, "crores": 1e7, "m": 1e6, "mn": 1e6}
PERIOD_ALIASES = {
    "YEARLY": ["annum", "p.a", "pa", "annually", "annual", "yearly", "year", "yr", "jahr", "j", "jährlich", "lpa"],
    "MONTHLY": ["month", "monthly", "p.m", "pm", "mo", "mth", "monat", "monatlich"],
    "WEEKLY": ["week", "weekly", "wk", "woche"],
    "DAILY": ["day", "daily", "tag"],
    "HOURLY": ["hour", "hourly", "hr", "ph", "p.h", "std", "stunde"],
}
#: Scale words of notes beside those of texts.
NOTE_SCALES = SCALE_ALIASES | {"thousand": 1e3, "thousands": 1e3, "million": 1e6, "millions": 1e6}
#: Figures from here on are taken for full amounts, whatever scale a note states.
LEAST_FULL = 1e3

_TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
_ONES = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
_ONE = "|".join(sorted(_ONES, key=len, reverse=True))
_WORD = rf"(?:{'|'.join(_TENS)})(?:[- ](?:{_ONE}))?|{_ONE}|hundred"
_CUR = r"us\$|s\$|\$|₹|£|€|rs\.?|inr|usd|sgd|gbp|eur|aed|dhs?\.?|rupees?"
_SCALE = r"lpa|lakhs?|lacs?|crores?|cr|mn|k|l|m"
_NUM = r"\d+(?:[.,'’]\d+)*"
_ENDS = r"(?![a-z])"
_FIGURE = rf"(?:({_NUM})|(?<![a-z])({_WORD})(?![a-z]))\s*(?:({_SCALE}){_ENDS})?"
#: first figure, its scale; second figure of a range, its scale
PAY = rf"(?<![a-z0-9#])(?:({_CUR})\s*)?{_FIGURE}(?:\s*(?:-|–|—|to|bis|and)\s*(?:(?:{_CUR})\s*)?{_FIGURE})?"
_PERIOD = "|".join(sorted((a.replace(".", r"\.\s?") for v in PERIOD_ALIASES.values() for a in v), key=len, reverse=True))
#: what follows the pay itself: bonuses, leave, experience and the like
EXTRAS = r"\s*(?:\+\s|\bplus\b|\(|,\s*\d+\s*(?:days|weeks)|,\s*(?!\d)|\bincl|&).*$"
#: a unit in brackets or behind a comma belongs to the pay, and so does what stands behind a bracket before any figure
_UNIT = rf"(?:(?:per|a|an|each|every|/)\s*)?(?:{_CUR}|{_SCALE}|{_PERIOD})(?:\s*(?:per|a|an|/)?\s*(?:{_PERIOD}))?"
INSIDE = [(rf"\(\s*({_UNIT})\s*\)", " $1 "), (rf",\s*(?={_UNIT}(?![a-z]))", " "), (r"^([^0-9(]*)\([^0-9)]*\)", "$1 ")]


def number_words() -> list[tuple[str, float]]:
    """English number words up to one hundred with their values."""
    words = {w: k + 1 for k, w in enumerate(_ONES)} | _TENS | {"hundred": 100}
    words |= {f"{t}{mark}{o}": v + k + 1 for t, v in _TENS.items() for k, o in enumerate(_ONES[:9]) for mark in "- "}
    return [(w, float(v)) for w, v in words.items()]


def number(c: Column, scaled: Column) -> Column:
    """A figure in English, Indian or German notation as double.

    A mark is a decimal mark if it stands once and is not followed by exactly
    three digits, or if a scale word follows the figure (``1.125 crore``).
    """
    clean = F.regexp_replace(c, "['’]", "")
    last_comma, last_dot = F.length(clean) - F.instr(F.reverse(clean), ","), F.length(clean) - F.instr(F.reverse(clean), ".")
    both = clean.contains(",") & clean.contains(".")
    decimal = (
        F.when(both & (last_comma > last_dot), F.translate(F.regexp_replace(clean, r"\.", ""), ",", "."))
        .when(both, F.regexp_replace(clean, ",", ""))
        .when(clean.rlike(r"^\d+[.,]\d+$") & (~clean.rlike(r"[.,]\d{3}$") | (scaled & clean.contains("."))), F.translate(clean, ",", "."))
        .otherwise(F.regexp_replace(clean, "[.,]", ""))
    )
    return F.when(c != "", decimal.try_cast("double"))


def _evaluated(df: DataFrame, keep: list[str], cols: list[Column]) -> DataFrame:
    """``keep`` and ``cols``, evaluated once: later filters aren't pushed below and so don't repeat them."""
    return df.select(*keep, F.inline(F.array(F.struct(*cols))))


def _aliases(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))  # a few dozen rows, fixed


def converted(value: Column, factor: Column, offset: Column | None = None) -> Column:
    """A value in common units."""
    return value * factor + (F.lit(0.0) if offset is None else offset)


def measured(rows: DataFrame, text: str, unit_field: str | None, source: str, aliases: DataFrame, defaults: DataFrame) -> DataFrame:
    """``rows`` with ``value`` and ``unit``: the quantity that a text states, in common units.

    ``aliases``: alias (lower case), unit, factor, offset, with value * factor +
    offset in ``unit``; ``defaults``: source, alias. The first number of the text
    counts, its unit is the first known of the word behind it, ``unit_field`` and
    the source's default. Without number or known unit both are null. A null text,
    unknown sources and repeated rows give a row each; aliases are unique.
    """
    names = F.broadcast(aliases.select(F.lower("alias").alias("_alias"), F.col("unit").alias("_unit"), "factor", "offset"))  # a unit table
    number_and_unit = r"([+\-\u2212]?\d+(?:\.\d+)?)\s*([\p{L}°%µ/]+[\p{L}\d²³/]*)?"
    t = F.lower(F.col(text))
    x = rows.withColumns({"_n": F.translate(F.regexp_extract(t, number_and_unit, 1), "\u2212", "-").try_cast("double"), "_said": F.regexp_extract(t, number_and_unit, 2), "_field": F.lower(F.col(unit_field)) if unit_field else F.lit(None).cast("string")})
    x = x.join(F.broadcast(defaults.select(F.col("source").alias(source), F.lower("alias").alias("_default"))), source, "left")
    for k in ("_said", "_field", "_default"):
        x = x.join(names.select(F.col("_alias").alias(k), F.struct("_unit", "factor", "offset").alias(f"{k}_u")), k, "left")
    unit = F.coalesce("_said_u", "_field_u", "_default_u")
    x = x.withColumn("_u", F.when(F.col("_n").isNotNull(), unit))
    return x.select(*[F.col(c) for c in rows.columns], converted(F.col("_n"), F.col("_u.factor"), F.col("_u.offset")).alias("value"), F.col("_u._unit").alias("unit"))


def noted_units(note: Column) -> Column:
    """struct<period, scale> that a source's note on pay names, each null unless exactly one is named."""
    words = F.regexp_extract_all(F.lower(note), F.lit(r"[\p{L}.]+"), F.lit(0))
    words = F.transform(words, lambda w: F.regexp_replace(w, r"\.+$", ""))
    periods = {a: p for p, v in PERIOD_ALIASES.items() for a in v if len(a) > 1}

    def only(known: dict) -> Column:
        table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        named = F.array_distinct(F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda v: v.isNotNull()))
        return F.when(F.size(named) == 1, named[0])

    scales = {a: v for a, v in NOTE_SCALES.items() if len(a) > 2}
    return F.when(only(periods).isNotNull(), F.struct(only(periods).alias("period"), only(scales).alias("scale")))


def annual_pay(jobs: DataFrame, boards: DataFrame, fx: DataFrame, periods: DataFrame, id_col: str = "id", pay_col: str = "salary") -> DataFrame:
    """``id, source, inr_min, inr_max``: a row per record whose base pay can be told.

    - The text counts before the fields, for the figures as for each unit; the
      board's note and default currency settle what neither says.
    - A figure without any unit outside a board with such a note is no pay, nor
      is 0; then fields with figures may still tell.
    - A single figure is both ends; the smaller comes first. Extras behind the
      base pay (bonus, leave, cover) are cut off before figures are read.
    - Null pay structs, null sources and empty tables give no row and no error;
      repeated ids give a row each. Pay is rounded half up to whole rupees.
    """
    spark = jobs.sparkSession
    cur = _aliases(spark, list(CURRENCY_ALIASES.items()), "cur_alias string, t_currency string")
    scale = _aliases(spark, list(SCALE_ALIASES.items()), "sc_alias string, t_scale double")
    per = _aliases(spark, [(a, p) for p, v in PERIOD_ALIASES.items() for a in v], "per_alias string, t_period string")
    notes = boards.select("source", "default_currency", noted_units(F.col("pay_note")).alias("note"))
    s = F.col(pay_col)
    body = F.lower(F.regexp_replace(s["raw"], r"[\p{Z}\s​﻿­]+", " "))
    for pattern, kept in INSIDE:
        body = F.when(body.rlike("[(,]"), F.regexp_replace(body, pattern, kept)).otherwise(body)
    body = F.regexp_replace(body, EXTRAS, "")
    x = jobs.select(
        F.col(id_col).alias("id"), F.col("source"), body.alias("t"), s["currency"].alias("f_currency"), s["period"].alias("f_period"), s["min"].alias("f_min"), s["max"].alias("f_max")
    ).where(F.col("t").rlike(rf"\d|{_ONE}|{'|'.join(_TENS)}|hundred") | F.col("f_min").isNotNull() | F.col("f_max").isNotNull())
    # one pass of the pattern: its seven groups and the rest of the text
    parts = F.split(F.regexp_replace("t", rf"^.*?{PAY}(.*)$", "\u0001".join(f"${k}" for k in range(1, 9))), "\u0001")
    x = _evaluated(x, ["id", "source", "f_currency", "f_period", "f_min", "f_max"], [F.col("t"), parts.alias("g")])
    g = lambda k: F.nullif(F.get("g", F.lit(k)), F.lit("")) if k else F.when(F.size("g") == 8, F.nullif(F.col("g")[0], F.lit("")))
    x = _evaluated(x, ["id", "source", "f_currency", "f_period", "f_min", "f_max", "t"], [
        g(1).alias("n1"), g(2).alias("w1"), g(3).alias("s1"), g(4).alias("n2"), g(5).alias("w2"),
        F.regexp_replace(F.coalesce(g(0), F.nullif(F.regexp_extract("t", rf"(?<![a-z])({_CUR})(?![a-z$])", 1), F.lit("")), g(6), g(3)), r"\.", "").alias("cur_alias"),
        F.coalesce(g(6), g(3)).alias("sc_alias"),
        F.regexp_replace(F.regexp_replace(F.regexp_extract(g(7), rf"(?:^|[^a-z])({_PERIOD})(?![a-z])", 1), r"\s", ""), r"^([a-z])\.([a-z])$", "$1.$2").alias("per_alias"),
    ])
    word = _aliases(spark, number_words(), "word string, value double")
    x = x.join(cur, "cur_alias", "left").join(scale, "sc_alias", "left").join(per, "per_alias", "left").join(F.broadcast(notes), "source", "left")
    x = x.join(scale.toDF("s1", "first_scale"), "s1", "left").join(word.toDF("w1", "v1"), "w1", "left").join(word.toDF("w2", "v2"), "w2", "left")
    scaled = F.col("t_scale").isNotNull()
    x = _evaluated(x, [c for c in x.columns if c not in ("n1", "n2", "v1", "v2", "w1", "w2")], [F.coalesce(number(F.col("n1"), scaled), "v1").alias("a"), F.coalesce(number(F.col("n2"), scaled), "v2").alias("b")])
    a, b = F.col("a"), F.col("b")
    ok = (a > 0) & (F.coalesce(b, F.lit(1.0)) > 0)
    # lakh and crore without a period are meant by the year, as is a figure in thousands
    said_period = F.coalesce("t_period", F.when(scaled, "YEARLY"))
    t_unit = F.col("t_currency").isNotNull() | said_period.isNotNull()
    x = x.withColumn("use_text", F.coalesce(ok & (t_unit | F.col("note").isNotNull() | F.col("f_period").isNotNull() | F.col("f_currency").isNotNull()), F.lit(False)) & ~F.col("t").rlike("(?<![a-z])(grade|level|band|see|ref)(?![a-z])"))
    text_scale = F.coalesce("first_scale", "t_scale", F.lit(1.0))
    lo = F.when(F.col("use_text"), a * text_scale).otherwise(F.coalesce("f_min", "f_max"))
    hi = F.when(F.col("use_text"), F.coalesce(b * F.coalesce("t_scale", F.lit(1.0)), a * text_scale)).otherwise(F.coalesce("f_max", "f_min"))
    bare = ~(F.col("use_text") & (t_unit | scaled))
    x = _evaluated(x, ["id", "source"], [
        lo.alias("lo"), hi.alias("hi"),
        F.coalesce(F.when(F.col("use_text"), F.col("t_currency")), "f_currency", "default_currency").alias("currency"),
        F.coalesce(F.when(F.col("use_text"), said_period), F.upper("f_period"), "note.period").alias("period_code"),
        F.when(bare & (F.greatest(lo, hi) < LEAST_FULL), F.coalesce("note.scale", F.lit(1.0))).otherwise(F.lit(1.0)).alias("scale"),
    ]).where("lo > 0 and hi > 0")
    x = x.join(F.broadcast(fx), "currency").join(F.broadcast(periods), "period_code")
    factor = F.col("scale") * F.col("inr_per_unit") * F.col("per_year")
    inr = lambda c: F.round(converted(c, factor), 0).cast("bigint")
    return x.select("id", "source", inr(F.least("lo", "hi")).alias("inr_min"), inr(F.greatest("lo", "hi")).alias("inr_max"))
