"""Dates and periods written in many ways, as native columns.

A cell is cut into its numbers and its shape: the same text with every number
and month name replaced by a letter for its class. The shape picks a rule, and
the rule says which number is the year, the month, the day or the quarter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.text import collapse, let

#: Month names (fixed values); a name's first three letters are its short form.
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MONTHS = tuple(m[:3] for m in MONTH_NAMES)
#: A short form of four letters (fixed value).
LONGER_SHORT = "sept"
PERIOD = "struct<key:string,grain:string,label:string,year:int,ambiguous:boolean>"
#: Words that limit a request to years, and words between two years (fixed values).
LIMIT_WORDS = {
    "after": ("after",),
    "since": ("since", "from", "starting", "starting in", "starting from"),
    "before": ("before", "prior to"),
    "until": ("until", "till", "up to", "upto"),
    "in": ("in", "during", "for the year", "of the year"),
}
SPAN_WORDS = ("and", "to", "till", "until", "through", "thru", "-", "–", "—")
LAST_WORDS = ("last", "past", "previous")


@dataclass(frozen=True)
class Rule:
    """A shape and the places of year, month, day and quarter among its numbers; None where the shape has none.

    Classes: n, N, T and Y are numbers of one to four digits, M a month name,
    Q and F the marks of quarters and fiscal years.
    """

    grain: str
    shape: str
    year: int | None = None
    month: int | None = None
    day: int | None = None
    quarter: int | None = None
    day_first: bool = False


PERIOD_RULES = (
    Rule("year", "Y", 0),
    Rule("fiscal", "F ?'?[NY](?: ?[-/–] ?[NY])?", 0),
    Rule("quarter", "Qn ?[-/ ]? ?(?:F ?)?'?[NY]", 1, quarter=0),
    Rule("quarter", "Y ?[-/ ]? ?Qn", 0, quarter=1),
    Rule("day", "Y[-/.][nN][-/.][nN]", 0, 1, 2),
    Rule("day", "[nN][-/.][nN][-/.][NY]", 2, 1, 0, day_first=True),
    Rule("day", "[nN][ /-]+M[ ,/-]+[NY]", 1, day=0),
    Rule("day", "M [nN],? Y", 1, day=0),
    Rule("month", "Y[-/.][nN]", 0, 1),
    Rule("month", "[nN][-/.]Y", 1, 0),
    Rule("month", "M[ ,/'’-]+[NY]", 0),
    Rule("month", "Y[ ,/-]+M", 0),
    Rule("monthName", "M"),
)
#: Dates may be followed by other text; what a rule lacks is the first month or day.
DATE_RULES = (
    Rule("day", "Y[-/.][nN][-/.][nN].*", 0, 1, 2),
    Rule("day", r"[nN][-/.][nN][-/.]Y(?!\w).*", 2, 1, 0, day_first=True),
    Rule("day", r"[nN][ /.-]+M\.?[ ,/.-]+[NTY](?!\w).*", 1, day=0),
    Rule("day", r"M\.? +[nN],? +Y(?!\w).*", 1, day=0),
    Rule("month", r"M\.?,? +Y(?!\w).*", 0),
    Rule("year", "Y(?: *[-–/] *[NTY])?", 0),
)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _names(loose: bool) -> str:
    """A pattern of month names; loosely, any word of up to nine letters that starts as one does."""
    if loose:
        return f"(?:{'|'.join(m.lower() for m in MONTHS)})[a-z]{{0,6}}"
    return "|".join([*(m.lower() for m in MONTH_NAMES), LONGER_SHORT, *(m.lower() for m in MONTHS)])


def _shape(text: Column, loose: bool) -> Column:
    """Lower-case text with numbers and known words replaced by their class letters."""
    word = lambda c, pattern, letter: F.regexp_replace(c, f"(?<![a-z])(?:{pattern})(?![a-z])", letter)
    out = F.regexp_replace(text, r"(?<=\d)(?:st|nd|rd|th)(?![a-z])", "")
    for pattern, letter in ((_names(loose), "M"), ("q", "Q"), ("fy", "F")):
        out = word(out, pattern, letter)
    for digits, letter in ((4, "Y"), (3, "T"), (2, "N"), (1, "n")):
        out = F.regexp_replace(out, rf"(?<!\d)\d{{{digits}}}(?!\d)", letter)
    return out


def _read(text: Column, rules: tuple[Rule, ...], loose: bool, body) -> Column:
    """Hands ``body`` the parts of a text: rule (its number), grain, year, month, day, quarter, swap and ambiguous; nulls where no rule fits."""
    def by_rule(rule: Column, values) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), rule)

    def chosen(shape: Column) -> Column:
        out = F.lit(None).cast("int")
        for k, r in reversed(list(enumerate(rules))):
            out = F.when(shape.rlike(f"^(?:{r.shape})$"), F.lit(k)).otherwise(out)
        return out

    def parts(x: Column) -> Column:
        rule, numbers = x["rule"], x["numbers"]
        pick = lambda field: F.get(numbers, by_rule(rule, [getattr(r, field) for r in rules]).cast("int"))
        year = pick("year")
        full = F.when(F.char_length(year) <= 2, _int(year) + 2000).otherwise(_int(year))
        other = F.get(numbers, F.lit(1))
        named = (F.instr(F.lit("".join(m.lower() for m in MONTHS)), F.substring(x["name"], 1, 3)) + 2) / 3
        month = F.coalesce(_int(pick("month")), F.when(x["name"] != "", named).cast("int"))
        day = _int(pick("day"))
        first = by_rule(rule, [r.day_first for r in rules])
        swap = first & (month > 12) & (day <= 12)
        return F.struct(
            rule.alias("rule"), by_rule(rule, [r.grain for r in rules]).alias("grain"), full.alias("year"), F.when(swap, day).otherwise(month).alias("month"), F.when(swap, month).otherwise(day).alias("day"),
            _int(pick("quarter")).alias("quarter"), F.when(other.isNotNull(), F.when(F.char_length(other) <= 2, _int(other) + 2000).otherwise(_int(other))).alias("second"),
            (first & (month <= 12) & (day <= 12) & (month != day)).alias("ambiguous"),
        )

    def cut(s: Column) -> Column:
        return F.struct(let(_shape(s, loose), chosen).alias("rule"), F.regexp_extract_all(s, F.lit(r"\d+"), F.lit(0)).alias("numbers"), F.regexp_extract(s, f"(?<![a-z])({_names(loose)})(?![a-z])", 1).alias("name"))

    return let(text, lambda s: let(cut(s), lambda x: F.when(x["rule"].isNotNull(), let(parts(x), body))))


def _plausible(y: Column) -> Column:
    return y.between(1900, 2100)


def _period(key: Column, grain: Column | str, label: Column, year: Column, ambiguous: Column | None = None) -> Column:
    return F.struct(key.alias("key"), (F.lit(grain) if isinstance(grain, str) else grain).alias("grain"), label.alias("label"), year.alias("year"), (F.lit(False) if ambiguous is None else ambiguous).alias("ambiguous"))


def _month_name(m: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in MONTHS]), m - 1)


def _month_period(y: Column, m: Column) -> Column:
    return F.when(_plausible(y) & m.between(1, 12), _period(F.format_string("%04d-%02d", y, m), "month", F.concat_ws(" ", _month_name(m), y.cast("string")), y))


def _built(p: Column) -> Column:
    """The period of the parts that a rule has read."""
    y, m, d, q = p["year"], p["month"], p["day"], p["quarter"]
    text = y.cast("string")
    day_key = F.format_string("%04d-%02d-%02d", y, m, d)
    start, end = F.when(p["second"].isNull(), y - 1).otherwise(y), F.coalesce(p["second"], y)
    short = F.right(end.cast("string"), F.lit(2))
    made = {
        "year": F.when(_plausible(y), _period(text, "year", text, y)),
        "fiscal": F.when(_plausible(start) & (end - start == 1), _period(F.concat(F.lit("FY"), start, F.lit("-"), short), "fiscal", F.concat(F.lit("FY "), start, F.lit("–"), short), start)),
        "quarter": F.when(_plausible(y) & q.between(1, 4), _period(F.concat(text, F.lit("-Q"), q), "quarter", F.concat(F.lit("Q"), q, F.lit(" "), text), y)),
        "month": _month_period(y, m),
        "day": F.when(_plausible(y) & m.between(1, 12) & F.try_to_date(day_key).isNotNull(), _period(day_key, "day", F.concat_ws(" ", d.cast("string"), _month_name(m), text), y, p["ambiguous"])),
        "monthName": _period(F.format_string("M%02d", m), "monthName", _month_name(m), F.lit(None).cast("int")),
    }
    out = F.lit(None).cast(PERIOD)
    for grain, value in made.items():
        out = F.when(p["grain"] == grain, value).otherwise(out)
    return out


def parse_period(cell: Column) -> Column:
    """The period that a cell names: year, fiscal year, quarter, month, day or month name; null for none.

    An ISO day is read at once; all else goes through the rules.
    """
    iso = F.coalesce(cell.rlike(r"^(?:19|20)\d\d-\d\d-\d\d$"), F.lit(False))
    y, m, d = _int(F.substring(cell, 1, 4)), _int(F.substring(cell, 6, 2)), _int(F.substring(cell, 9, 2))
    at_once = F.when(F.try_to_date(cell, "yyyy-MM-dd").isNotNull(), _period(cell, "day", F.concat_ws(" ", d.cast("string"), _month_name(m), y.cast("string")), y))
    text = F.lower(collapse(cell))
    text = F.regexp_replace(text, r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})[t ][\d:.]+(?:z|[+-]\d{2}:?\d{2})?$", "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"^q([1-4])(?=\d)", "q$1 "), r"(?<=[a-z])\.(?=[ ,/'’-]|$)", "")
    return F.when(iso, at_once).otherwise(_read(text, PERIOD_RULES, False, _built))


def parse_date(cell: Column) -> Column:
    """The first day that a cell names, day first where numbers leave it open; a year is its 1 January."""
    def day_of(p: Column) -> Column:
        far = (p["grain"] == "year") & ~p["year"].between(1900, 2099)
        month = F.when(p["grain"] == "year", F.lit(1)).otherwise(p["month"])
        return F.when(~far, F.try_to_date(F.format_string("%04d-%02d-%02d", p["year"], month, F.coalesce(p["day"], F.lit(1)))))

    return _read(F.lower(F.trim(F.regexp_replace(cell, r"\[[^\]]*\]", " "))), DATE_RULES, True, day_of)


# ---------------------------------------------------------------- keys
_KEY = r"^(\d{4})(?:-Q([1-4])|-(\d{2})(?:-(\d{2}))?)?$"


def _key_part(key: Column, group: int) -> Column:
    """Year, quarter, month or day of a calendar key as a number, null where it has none."""
    return _int(F.regexp_extract(key, _KEY, group))


def bucket(key: Column, to: str) -> Column:
    """A period key made coarser (year, quarter or month); fiscal years, month names and years stay as they are."""
    year, quarter, month = _key_part(key, 1), _key_part(key, 2), _key_part(key, 3)
    coarse = {
        "year": lambda: F.when(F.coalesce(quarter, month).isNotNull(), F.substring(key, 1, 4)),
        "quarter": lambda: F.when(month.isNotNull(), F.concat_ws("-Q", year, F.ceil(month / 3))),
        "month": lambda: F.when(month.isNotNull(), F.substring(key, 1, 7)),
    }
    if to not in coarse:
        raise ValueError(f"no bucket {to!r}")
    return F.coalesce(coarse[to](), key)


def ordinal(key: Column) -> Column:
    """A key's place on its own grain's time line, so missing steps show as gaps."""
    year, quarter, month, day = (_key_part(key, g) for g in (1, 2, 3, 4))
    days = F.when(day.isNotNull(), F.unix_date(F.try_to_date(key)))
    fiscal, name = _int(F.regexp_extract(key, r"^FY(\d{4})-\d{2}$", 1)), _int(F.regexp_extract(key, r"^M(\d{2})$", 1))
    return F.coalesce(F.when(day.isNotNull(), days).otherwise(F.coalesce(year * 12 + month - 1, year * 4 + quarter - 1, year)), fiscal, name - 1).cast("long")


def month_and_year(month: Column, year: Column) -> Column:
    """A month-name period and a year period read together."""
    ok = (month["grain"] == "monthName") & (year["grain"] == "year")
    return F.when(ok, _month_period(_int(year["key"]), _int(F.substring(month["key"], 2, 2))))


def automatic_bucket(grain: str, distinct: int, months: int = 0) -> str | None:
    """The bucket in which a time axis is shown: many days become months or years, many months years; None leaves the keys."""
    if grain == "day" and distinct > 16:
        return "month" if 3 <= months <= 36 else "year"
    return "year" if grain == "month" and distinct > 48 else None


def exported(period: Column) -> Column:
    """Struct (date, number, text) of a period for a typed sheet: days and months as dates, years as numbers, all else as its label."""
    key, grain = period["key"], period["grain"]
    dated = F.when(grain == "day", F.try_to_date(key)).when(grain == "month", F.try_to_date(F.concat(key, F.lit("-01"))))
    number = F.when(grain == "year", _int(key))
    return F.struct(dated.alias("date"), number.alias("number"), F.when(dated.isNull() & number.isNull(), period["label"]).alias("text"))


def limit_of(text: str, today: date) -> tuple[date | None, date | None] | None:
    """The closed interval of days that a request's words name, open ends as None; None without any."""
    words = " ".join(text.lower().split())
    year = r"((?:19|20)\d{2})"
    either = lambda options: "(?:" + "|".join(re.escape(w) for w in sorted(options, key=len, reverse=True)) + ")"
    opens, closes = (lambda y: date(y, 1, 1)), (lambda y: date(y, 12, 31))
    if span := re.search(rf"{year}\s*{either(SPAN_WORDS)}\s*{year}\b", words):
        low, high = sorted(map(int, span.groups()))
        return opens(low), closes(high)
    if back := re.search(rf"\b{either(LAST_WORDS)}\s+(\d{{1,3}})\s+years?\b", words):
        return today.replace(year=today.year - int(back[1]), day=min(today.day, 28)), today
    bounds = {"after": lambda y: (opens(y + 1), None), "since": lambda y: (opens(y), None), "before": lambda y: (None, closes(y - 1)), "until": lambda y: (None, closes(y)), "in": lambda y: (opens(y), closes(y))}
    for name, options in LIMIT_WORDS.items():
        if hit := re.search(rf"\b{either(options)}\s+{year}\b", words):
            return bounds[name](int(hit[1]))
    return None
