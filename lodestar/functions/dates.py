"""Years and dates out of free text, natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATEST = 2027


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract(c, pattern, group)
    return F.when(got != "", got.cast("int"))


def title_year(title: Column) -> Column:
    """The year of a '(yyyy)' in a title."""
    y = _first(title, r"\((\d{3,4})\)")
    return F.when(y.between(1, LATEST), y)


def analytic_year(title: Column, raw: Column, parsed: Column) -> Column:
    """struct(year, confidence): an era mark in the text, then title against parsed year, then plausible numbers, then the title."""
    hint = title_year(title)
    bc = _first(raw, r"(?i)\b(\d{1,4})\s*(BC|BCE)\b")
    ad = F.coalesce(_first(raw, r"(?i)\b(AD|CE)\s*(\d{1,4})\b", 2), _first(raw, r"(?i)\b(\d{1,4})\s*(AD|CE)\b"))
    numbers = F.transform(F.regexp_extract_all(raw, F.lit(r"\b\d{1,4}\b"), F.lit(0)), lambda x: x.cast("int"))
    likely = F.filter(numbers, lambda y: y.between(1, LATEST))
    close = F.filter(likely, lambda y: F.abs(y - hint) <= 5)
    some = F.size(likely) > 0
    far = some & ~F.exists(likely, lambda y: F.abs(y - hint) < 50)

    def out(year: Column, label: str) -> Column:
        return F.struct(year.cast("int").alias("year"), F.lit(label).alias("confidence"))

    return (
        F.when(bc.isNotNull(), out(-bc, "high"))
        .when(ad.isNotNull(), out(ad, "high"))
        .when(hint.isNotNull() & parsed.isNotNull() & (F.abs(parsed - hint) >= 50), out(hint, "title_year_override"))
        .when(parsed.between(-5000, LATEST), out(parsed, "medium"))
        .when(hint.isNotNull() & (F.size(close) > 0), out(F.element_at(close, -1), "low"))
        .when(hint.isNotNull() & far, out(hint, "title_year_override"))
        .when(some, out(F.element_at(likely, -1), "low"))
        .when(hint.isNotNull(), out(hint, "title_year_fallback"))
        .otherwise(out(F.lit(None), "low"))
    )


def date_of(raw: Column) -> Column:
    """The first date written in one of the known forms."""
    forms = [(r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"), (r"\d{1,2} [A-Z][a-z]+ \d{4}", "d MMMM yyyy"), (r"[A-Z][a-z]+ \d{1,2}, \d{4}", "MMMM d, yyyy"), (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy")]
    return F.coalesce(*(F.try_to_date(F.regexp_extract(raw, f"({p})", 1), f) for p, f in forms))


def date_range(raw: Column) -> Column:
    """struct(year, century, start, end, confidence): confidence grows by a quarter for each part found."""
    year = _first(raw, r"\b(\d{3,4})\b")
    parts = F.split(raw, " to | – ")
    start = date_of(F.element_at(parts, 1))
    end = F.when(F.size(parts) > 1, date_of(F.element_at(parts, -1)))
    sure = F.lit(0.25) + sum(((c.isNotNull()).cast("int") * 0.25 for c in (year, start, end)), F.lit(0.0))
    return F.struct(year.alias("year"), (F.floor((year - 1) / 100) + 1).cast("int").alias("century"), start.alias("start"), end.alias("end"), sure.alias("confidence"))


def date_reasons(raw: Column) -> Column:
    """What is wrong with a date text, as a list."""
    r = date_range(raw)
    lost = F.coalesce(F.trim(raw), F.lit("")) == ""
    found = F.array(
        F.when(F.contains(F.lower(raw), F.lit("unknown")) | F.contains(F.lower(raw), F.lit("tbd")), "suspicious_date_text"),
        F.when(r["year"].isNull(), "unparsed_year").when(~r["year"].between(1, 2100), "year_out_of_range"),
        F.when(r["start"] > r["end"], "start_after_end"),
    )
    return F.when(lost, F.array(F.lit("missing_date"))).otherwise(F.filter(found, lambda x: x.isNotNull()))


MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: What a word or a numbered month of a date text stands for.
MONTH_OF = {w: k for k, m in enumerate(MONTHS, 1) for w in {m, m[:3], m[:4] if m == "september" else m[:3], f"m{k}", f"m{k:02d}"}}
JOINS, BEFORE, AFTER = ["-", "–", "—", "−", "to", "until"], ["bc", "bce"], ["ad", "ce"]
_PARTS = ("day", "month", "year", "era")


def _tokens(raw: Column) -> Column:
    """Words, numbers and dashes of a date text, in lower case; numeric forms are written as day, numbered month and year."""
    text = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\([^)]*\)|\[[^\]]*\]", " "), r"(?i)\bb\.?c\.?(e\.?)?(?![a-z])", " bc "))
    text = F.regexp_replace(F.regexp_replace(text, r"\b(\d{4})-(\d{2})-(\d{2})\b", "$3 m$2 $1"), r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", "$1 m$2 $3")
    text = F.regexp_replace(text, r"(\d)(?:st|nd|rd|th)\b", "$1")
    return F.regexp_extract_all(text, F.lit(r"m\d{1,2}\b|[a-zà-ÿ]+|\d{1,4}|[-–—−]"), F.lit(0))


def _read(acc: Column, t: Column) -> Column:
    """The state after one more token. Side 0 is read up to the first dash after anything was found, side 1 from there."""
    side = acc["side"]
    day, month, year, era = (F.when(side == 0, acc[f"{p}0"]).otherwise(acc[f"{p}1"]) for p in _PARTS)
    number = F.when(F.rlike(t, F.lit(r"^\d")), t.cast("int"))
    said = F.try_element_at(F.create_map(*(F.lit(x) for kv in MONTH_OF.items() for x in kv)), t)
    before, after, join = t.isin(BEFORE), t.isin(AFTER), t.isin(JOINS)
    # A number is the year by its size, after "AD", or where day and month are there already.
    big = (F.length(t) >= 3) | (number > 31) | (t == "00") | acc["ad"] | (day.isNotNull() & month.isNotNull())
    mark = (before | after) & (day.isNotNull() | year.isNotNull())
    # An era mark makes a lone number before it the year.
    turned = mark & year.isNull() & day.isNotNull() & month.isNull()
    new = {
        "day": F.when(turned, None).when(number.isNotNull() & ~big & day.isNull() & (number > 0), number).otherwise(day),
        "month": F.when(said.isNotNull() & month.isNull(), said).otherwise(month),
        "year": F.when(turned, day).when(number.isNotNull() & big & year.isNull(), number).otherwise(year),
        "era": F.when(before, -1).when(after, 1).otherwise(era),
    }
    found = F.coalesce(day, month, year).isNotNull()
    sides = [F.when(side == k, v).otherwise(acc[f"{p}{k}"]).cast("int").alias(f"{p}{k}") for k in (0, 1) for p, v in new.items()]
    return F.struct(F.when(join & (side == 0) & found, 1).otherwise(side).alias("side"), (after & ~mark).alias("ad"), *sides)


def with_date_span(df: DataFrame, raw: str, into: str) -> DataFrame:
    """Adds struct(start_year, start_month, start_day, end_year, end_month, end_day) of a date text; years before our era are negative.

    One pass over the tokens fills day, month, year and era of both ends; what an end lacks comes from the other one: "3-5 May 1805",
    "3 May - 5 June 1805", "490-479 BC", "1914-18". A text of one end has it twice. Parts that no end has stay null.
    The pass is a column of its own, as an expression is worked out anew wherever it is named.
    """
    state = F.struct(F.lit(0).alias("side"), F.lit(False).alias("ad"), *(F.lit(None).cast("int").alias(f"{p}{k}") for k in (0, 1) for p in _PARTS))
    read = df.withColumn("\1tokens", _tokens(F.col(raw))).withColumn("\1read", F.aggregate("\1tokens", state, _read))
    return read.withColumn(into, _ends(F.col("\1read"))).drop("\1tokens", "\1read")


def _ends(s: Column) -> Column:
    """Both ends of a state, with what each lacks from the other."""
    two = s["side"] == 1
    # A short number after a lone year is the end of a year: its century is the year's.
    short = two & s["year0"].isNotNull() & s["day0"].isNull() & s["month0"].isNull() & s["day1"].isNotNull() & s["month1"].isNull() & s["year1"].isNull() & s["era0"].isNull() & s["era1"].isNull()
    lone = two & s["year0"].isNotNull() & s["day0"].isNull() & s["month0"].isNull() & s["year1"].isNotNull() & s["month1"].isNull() & (s["year1"] < 100) & (s["year0"] >= 1000) & s["era0"].isNull() & s["era1"].isNull()
    # The end of a year is in its century, or in the next one where it would lie before the year.
    of = lambda n: s["year0"] - s["year0"] % 100 + n + F.when(n < s["year0"] % 100, 100).otherwise(0)
    year1 = F.when(short, of(s["day1"])).when(lone, of(s["year1"])).otherwise(s["year1"])
    day1 = F.when(short, None).otherwise(s["day1"])
    # A small lone number before the dash is the year where the other end is a year alone with an era.
    early = two & s["year0"].isNull() & s["month0"].isNull() & s["day0"].isNotNull() & s["month1"].isNull() & s["year1"].isNotNull() & s["day1"].isNull()
    year0, day0 = F.when(early, s["day0"]).otherwise(s["year0"]), F.when(early, None).otherwise(s["day0"])
    era0, era1 = F.coalesce(s["era0"], s["era1"]), F.coalesce(s["era1"], s["era0"])
    y0, y1 = F.coalesce(year0, year1), F.coalesce(year1, year0)
    m0 = F.coalesce(s["month0"], F.when(day0.isNotNull() | year0.isNull(), s["month1"]))
    m1 = F.coalesce(s["month1"], F.when(~two | day1.isNotNull(), s["month0"]))
    d1 = F.coalesce(day1, F.when(~two, day0))
    sign = lambda y, era: y * F.coalesce(era, F.lit(1))
    return F.struct(sign(y0, era0).alias("start_year"), m0.alias("start_month"), day0.alias("start_day"), sign(y1, era1).alias("end_year"), m1.alias("end_month"), d1.alias("end_day"))


def span_text(year: Column, month: Column, day: Column) -> Column:
    """yyyy-mm-dd with what is missing as the first; null without a year."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat(F.when(year < 0, "-").otherwise(""), pad(F.abs(year), 4), F.lit("-"), pad(F.coalesce(month, F.lit(1)), 2), F.lit("-"), pad(F.coalesce(day, F.lit(1)), 2))
