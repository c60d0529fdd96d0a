"""Free records as rows of fixed columns, and the sinks that keep tables of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.periods import parse_date
from brindle.functions.text import collapse, group_key, site_of
from brindle.operators.core import keep_first
from brindle.operators.rows import blank, first_filled, pick_alias

#: Names under which records carry common fields (fixed values).
ALIASES = {
    "name": ("name", "title", "model", "car_name", "product"), "price": ("price", "cost", "ex_showroom", "amount"), "range_km": ("range", "range_km", "mileage"), "battery": ("battery", "battery_capacity"),
    "gazette_id": ("Gazette ID", "GazetteId", "Gazette No", "Gazette Number"),
}
#: Words of columns that date a row (fixed values).
DATE_WORDS = ("date", "year", "time", "period", "day", "month", "when", "published", "issued", "held", "established", "founded", "launched")
#: Words that show what a request is about (fixed values).
TOPICS = {
    "vehicles": ("ev", "evs", "car", "cars", "bike", "bikes", "motorcycle", "motorcycles", "scooter", "scooters", "suv", "suvs", "sedan", "sedans", "vehicle", "vehicles", "hatchback", "hatchbacks", "automobile", "automobiles"),
    "gazettes": ("gazette", "gazettes", "egazette", "notification", "notifications"),
    "parliament": ("parliament", "lok sabha", "rajya sabha", "debate", "debates"),
    "places": ("restaurant", "restaurants", "cafe", "cafes", "salon", "salons", "clinic", "clinics", "gym", "gyms", "hotel", "hotels", "shop", "shops"),
}
#: Region names that are searched as their cities (fixed values).
REGIONS = {name: ("Delhi", "Gurugram", "Noida", "Ghaziabad", "Faridabad") for name in ("delhi ncr", "ncr", "national capital region", "delhi/ncr", "delhi-ncr")}
#: Business states as people read them (fixed values).
BUSINESS_STATES = {"OPERATIONAL": "Operational", "CLOSED_TEMPORARILY": "Temporarily closed"}
#: Missing marks, scale words and currencies of the graph endpoint's own number reader (fixed values).
GRAPH_MISSING = ("", "-", "--", "—", "n/a", "na", "null", "none", "unknown")
GRAPH_SCALES = {"k": 1e3, "thousand": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "crore": 1e7, "crores": 1e7, "million": 1e6, "billion": 1e9}
GRAPH_CURRENCIES = ("₹", r"\$", "€", "£", r"rs\.?", r"inr\b", r"usd\b", r"eur\b", r"gbp\b")


# ---------------------------------------------------------------- rows
def picked(df: DataFrame, field: str, aliases: tuple[str, ...] | None = None) -> Column:
    """The first filled cell among a record's columns that may hold ``field``; empty where none is."""
    names = pick_alias(df.columns, list(aliases or ALIASES.get(field, (field,))))
    return F.coalesce(first_filled(*[F.col(f"`{n}`").cast("string") for n in names]), F.lit("")) if names else F.lit("")


def canonical_rows(records: DataFrame, url: str, columns: list[str]) -> DataFrame:
    """Records as rows of ``columns``: known fields by their aliases, the host as source, others by the same label; a row
    without name and price takes its first short cell as its first column."""
    free = [c for c in records.columns if c != url and not c.startswith("_")]
    same = lambda c: [k for k in free if k.lower().replace("_", " ") == c.lower().replace("_", " ")]
    source = F.regexp_replace(F.when(F.contains(F.col(url), F.lit("://")), F.regexp_extract(url, r"://([^/?#]*)", 1)).otherwise(F.col(url)), r"www\.", "")
    cells = {c: source if c == "source" else picked(records, "name" if c == "car_name" else c) if c in (*ALIASES, "car_name") else F.lit("") for c in columns}
    for c in columns:
        if same(c):
            cells[c] = F.coalesce(F.nullif(cells[c], F.lit("")), first_filled(*[F.col(f"`{k}`").cast("string") for k in same(c)]), F.lit(""))
    nameless = (picked(records, "name") == "") & (picked(records, "price") == "")
    short = [F.when(F.char_length(F.col(f"`{k}`").cast("string")) < 200, F.col(f"`{k}`").cast("string")) for k in free]
    if short:
        cells[columns[0]] = F.when(nameless & (cells[columns[0]] == ""), F.coalesce(first_filled(*short), F.lit(""))).otherwise(cells[columns[0]])
    return records.select(*[cells[c].alias(c) for c in columns])


def observation_axis(df: DataFrame, groupable: list[str], row: str = "_row") -> DataFrame:
    """Adds Observation ("Row n") where a table has no column to group by."""
    return df if groupable else df.withColumn("Observation", F.concat(F.lit("Row "), (F.col(row) + 1).cast("string")))


def place_rows(places: DataFrame, term: str, area: str) -> DataFrame:
    """Places (a VARIANT column ``place``) as rows; nameless and permanently closed ones are left out."""
    get = lambda path: F.coalesce(F.trim(F.try_variant_get("place", f"$.{path}", "string")), F.lit(""))
    state = get("businessStatus")
    kind = F.regexp_replace(get("primaryType"), "_", " ")
    known = F.lit(None).cast("string")
    for code, words in BUSINESS_STATES.items():
        known = F.when(state == code, F.lit(words)).otherwise(known)
    out = places.select(
        get("id").alias("id"), get("displayName.text").alias("name"),
        F.coalesce(F.nullif(get("primaryTypeDisplayName.text"), F.lit("")), F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 1000)))).alias("category"),
        get("nationalPhoneNumber").alias("phone"), get("websiteUri").alias("website"), F.when(get("websiteUri") != "", "yes").otherwise("no").alias("has_website"),
        F.try_variant_get("place", "$.rating", "double").alias("rating"), F.try_variant_get("place", "$.userRatingCount", "int").alias("reviews"), get("formattedAddress").alias("address"),
        F.lit(area).alias("area"), get("googleMapsUri").alias("source_url"), F.coalesce(known, F.initcap(F.regexp_replace(F.lower(state), "_", " "))).alias("business_status"), F.lit(term).alias("matched_query"), state.alias("_state"),
    )
    return out.filter("id <> '' and name <> '' and _state <> 'CLOSED_PERMANENTLY'").drop("_state")


def expanded_regions(df: DataFrame, locations: str) -> DataFrame:
    """One row per location; a lone region name becomes its main cities."""
    lone = F.when(F.size(locations) == 1, F.lower(collapse(F.get(locations, F.lit(0)))))
    cities = F.lit(None).cast("array<string>")
    for name, own in REGIONS.items():
        cities = F.when(lone == name, F.array(*[F.lit(c) for c in own])).otherwise(cities)
    return df.withColumn("location", F.explode(F.coalesce(cities, F.col(locations)))).drop(locations)


def session_meta(sessions: DataFrame) -> DataFrame:
    """A session list from stored rows with a JSON payload."""
    payload = F.try_parse_json(F.coalesce("payload_json", F.lit("{}")))
    filled = lambda k: F.coalesce(~F.try_variant_get(payload, f"$.{k}", "string").isin("", "{}", "[]", "false", "0"), F.lit(False))
    job = F.coalesce("job_id", F.try_variant_get(payload, "$.job_id", "string"))
    return sessions.select("id", "title", job.alias("job_id"), "updated_at", filled("intent").alias("has_intent"), filled("keep_live").alias("keep_live"))


def gazette_rows(records: DataFrame, text: str = "PDF_Text") -> DataFrame:
    """Notices with an id: by its aliases, else the first cell that looks like one; rows without are left out."""
    cells = F.array(*[F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in records.columns])
    looks = F.get(F.filter(cells, lambda v: v.rlike(r"^[A-Z0-9/-]{6,}$")), F.lit(0))
    ident = F.coalesce(F.nullif(picked(records, "gazette_id"), F.lit("")), looks)
    body = picked(records, text, (text,))
    return records.select(ident.alias("gazette_id"), picked(records, "subject", ("Subject", "subject")).alias("subject"), picked(records, "ministry", ("Ministry", "ministry")).alias("ministry"), body.alias("text")).filter("gazette_id is not null")


def document_url(ident: Column, base: str, this_year: int) -> Column:
    """The address of a notice's file guessed from its id: the last number, and the year of its date."""
    number, dated, any_year = F.regexp_extract(ident, r"-(\d+)\s*$", 1), F.regexp_extract(ident, r"-\d{4}(\d{4})-\d+$", 1), F.regexp_extract(ident, r"(20\d{2})", 1)
    year = F.coalesce(F.nullif(dated, F.lit("")), F.nullif(any_year, F.lit("")), F.lit(str(this_year)))
    return F.when(number != "", F.concat(F.lit(base.rstrip("/") + "/"), year, F.lit("/"), number, F.lit(".pdf"))).otherwise(F.lit(""))


def looks_like_price(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(r"\d|\blakh\b|\bcr\b|₹|rs\.?"), F.lit(False))


def graph_measure(cell: Column) -> Column:
    """Struct (value, unit) of a cell by the graph endpoint's own rules: durations in minutes, one scale word, floats; null where it is no measure."""
    raw = F.trim(F.coalesce(cell, F.lit("")))
    part = lambda unit: F.regexp_extract(raw, rf"(?i)(\d+(?:\.\d+)?)\s*(?:{unit})(?![a-z])", 1).try_cast("double")
    one = lambda unit: rf"(?:\d+(?:\.\d+)?\s*(?:{unit}))?\s*"
    units = ("hours?|hrs?|h", "minutes?|mins?|m", "seconds?|secs?|s")
    timed = raw.rlike(r"(?i)^(?=\d)" + "".join(map(one, units)) + "$")
    h, m, s = (F.coalesce(part(u), F.lit(0.0)) for u in units)
    negative = raw.rlike(r"^\(.*\)$")
    body = F.regexp_replace(F.when(negative, F.trim(F.regexp_extract(raw, r"^\((.*)\)$", 1))).otherwise(raw), rf"(?i)^(?:{'|'.join(GRAPH_CURRENCIES)})\s*", "")
    number = r"(?i)^([+-]?(?:\d[\d,]*(?:\.\d+)?|\.\d+))\s*([a-z][a-z0-9 /.-]{0,15})?%?$"
    digits, suffix = F.regexp_extract(body, number, 1), F.lower(F.trim(F.regexp_extract(body, number, 2)))
    grouped = ~F.contains(digits, F.lit(",")) | digits.rlike(r"^[+-]?\d{1,3}(?:,\d{2,3})*,\d{3}(?:\.\d+)?$")
    word = F.split_part(suffix, F.lit(" "), F.lit(1))
    scale = F.try_element_at(F.create_map(*[F.lit(x) for k, v in GRAPH_SCALES.items() for x in (k, v)]), word)
    unit = F.when(scale.isNotNull(), F.trim(F.regexp_replace(suffix, r"^\S+\s*", ""))).otherwise(suffix)
    value = F.regexp_replace(digits, ",", "").try_cast("double") * F.coalesce(scale, F.lit(1.0)) * F.when(negative, -1.0).otherwise(1.0)
    measured = F.struct(value.alias("value"), F.when(F.endswith(body, F.lit("%")), "%").otherwise(unit).alias("unit"))
    minutes = F.struct((h * 60 + m + s / 60).alias("value"), F.lit("min").alias("unit"))
    return F.when(F.lower(raw).isin(*GRAPH_MISSING), None).when(timed, minutes).when((digits != "") & grouped & ~unit.rlike(r"\d") & value.isNotNull(), measured)


# ---------------------------------------------------------------- choices
def date_column(df: DataFrame, columns: list[str]) -> str | None:
    """The column that dates rows: a date-named one of which half the cells read as dates, else any of which four fifths do. One aggregate over all rows."""
    there = [c for c in columns if c and not c.startswith("_")]
    filled = lambda c: ~blank(F.col(f"`{c}`").cast("string"))
    share = [(F.count_if(filled(c) & parse_date(F.col(f"`{c}`").cast("string")).isNotNull()) / F.nullif(F.count_if(filled(c)), F.lit(0))).alias(c) for c in there]
    if not share:
        return None
    found = {c: v or 0.0 for c, v in df.agg(*share).first().asDict().items()}
    named = re.compile("|".join(DATE_WORDS) + "|on$", re.IGNORECASE)
    for names, least in (([c for c in there if named.search(c)], 0.5), ([c for c in there if c not in ("url", "source_url")], 0.8)):
        best = max(((found[c], c) for c in names), default=(0.0, None))
        if best[0] >= least:
            return best[1]
    return None


def within_period(df: DataFrame, columns: list[str], low, high) -> DataFrame:
    """Rows inside a period by the table's own date column; undated rows, and tables without such a column, are kept."""
    column = date_column(df, columns)
    if column is None:
        return df
    day = parse_date(F.col(f"`{column}`").cast("string"))
    inside = (day >= low if low is not None else F.lit(True)) & (day <= high if high is not None else F.lit(True))
    return df.filter(day.isNull() | inside)


def topic_is(request: Column, topic: str) -> Column:
    """Whether a request names a topic, by whole words."""
    return F.coalesce(F.lower(request).rlike(r"\b(?:" + "|".join(TOPICS[topic]) + r")\b"), F.lit(False))


def search_queries(found: DataFrame, seeds: DataFrame, narrow: str, n: int) -> DataFrame:
    """Search queries of each request: narrow ones dropped, repeats by lower text dropped, filled from seeds up to ``n``. Both have request, query, place."""
    both = found.filter(~F.col("query").rlike(narrow)).withColumn("_s", F.lit(0)).unionByName(seeds.withColumn("_s", F.lit(1))).filter(~blank(F.col("query")))
    first = keep_first(both.withColumn("_k", F.lower(F.trim("query"))), ["request", "_k"], ["_s", "place"])
    return first.withColumn("_rn", F.row_number().over(Window.partitionBy("request").orderBy("_s", "place"))).filter(F.col("_rn") <= n).select("request", F.col("_rn").alias("place"), "query")


def header_map(headers: list[str], fields: list[str]) -> dict[str, list[str]]:
    """Output fields to table headers of the same letters and digits, else to headers that hold the field's words."""
    plain = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    out = {}
    for f in fields:
        same = [h for h in headers if plain(h) == plain(f)]
        out[f] = same[:1] or [h for h in headers if all(w in h.lower() for w in re.findall(r"[a-z0-9]+", f.lower()))][:1]
    return out


# ---------------------------------------------------------------- sinks
def insert_new(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert or ignore: the first row of each key stays, whatever comes later."""
    fresh = keep_first(new, keys, [order]).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def longest_text(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Each key's longest text; an equal length changes nothing."""
    size = lambda c: F.char_length(F.trim(F.coalesce(F.col(c), F.lit(""))))
    both = old.select(key, text, F.lit(1).alias("_o")).unionByName(new.select(key, text, F.lit(0).alias("_o")))
    return both.groupBy(key).agg(F.max_by(text, F.struct(size(text), F.col("_o"))).alias(text))


def without_jobs(df: DataFrame, gone: DataFrame, key: str = "job_id") -> DataFrame:
    """Cascade delete: rows of deleted jobs go, rows without a job stay."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def unexpired(df: DataFrame, created: str, now: Column, days: int) -> DataFrame:
    """Cached rows younger than ``days`` whole days."""
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(created).cast("timestamp"))) / (86_400 * 1_000_000))
    return df.filter(age < days)


def update_fields(stored: DataFrame, changes: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Late writers change only the fields that they name: each field's last change in order, else what was stored. Unknown keys are not created."""
    last = changes.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f"_n_{f}") for f in fields])
    return stored.join(last, key, "left").select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in fields else F.col(c) for c in stored.columns])


def export_table(df: DataFrame, source: str = "source") -> DataFrame:
    """A dataset as it leaves: every column as text, ``source_url`` at the end."""
    urls = [F.col(c) for c in ("source_url", source) if c in df.columns]
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns if c != "source_url"]
    return df.select(*cells, F.coalesce(first_filled(*urls), F.lit("")).alias("source_url") if urls else F.lit("").alias("source_url"))


def export_labels(columns: list[str], labels: list[str]) -> list[str]:
    """Readable headers aligned with the columns; those without one get their name in words."""
    return labels[: len(columns)] + [c.replace("_", " ").capitalize() for c in columns[len(labels) :]]


def sources_by_rows(df: DataFrame, url: str) -> DataFrame:
    """Rows of each site, keyed as sources are."""
    return df.groupBy(group_key(site_of(F.col(url))).alias("site")).agg(F.count(F.lit(1)).alias("rows"))
