"""Areas, tiles and scored leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.32
RINGS_KM = (2, 5, 10, 20, 50)


def tiles(areas: DataFrame, size_km: float) -> DataFrame:
    """Cuts rectangles (area, low_lat, low_lng, high_lat, high_lng) into tiles of about ``size_km``; position counts an area's tiles, nearest the centre first."""
    mid = (F.col("low_lat") + F.col("high_lat")) / 2
    high = (F.col("high_lat") - F.col("low_lat")) * KM_PER_DEGREE
    wide = (F.col("high_lng") - F.col("low_lng")) * KM_PER_DEGREE * F.cos(F.radians(mid))
    rows, cols = F.greatest(F.lit(1), F.ceil(high / size_km)), F.greatest(F.lit(1), F.ceil(wide / size_km))
    grid = areas.withColumn("rows", rows.cast("int")).withColumn("cols", cols.cast("int")).withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("rows") * F.col("cols") - 1)))
    r, c = F.floor(F.col("idx") / F.col("cols")), F.pmod("idx", "cols")
    dlat, dlng = (F.col("high_lat") - F.col("low_lat")) / F.col("rows"), (F.col("high_lng") - F.col("low_lng")) / F.col("cols")
    out = grid.select(
        "area", "idx",
        (F.col("low_lat") + r * dlat).alias("lat0"), (F.col("low_lng") + c * dlng).alias("lng0"),
        (F.col("low_lat") + (r + 1) * dlat).alias("lat1"), (F.col("low_lng") + (c + 1) * dlng).alias("lng1"),
        (F.pow(r + 0.5 - F.col("rows") / 2, 2) + F.pow(c + 0.5 - F.col("cols") / 2, 2)).alias("dist2"),
    )
    return out.withColumn("position", F.row_number().over(Window.partitionBy("area").orderBy("dist2", "idx"))).orderBy("area", "position")


def search_order(areas: DataFrame, terms: DataFrame) -> DataFrame:
    """Every area with every term in Latin-square order, so early searches cover all areas and all terms.

    Both sides are short lists of a request. (area, a) and (term, t) carry
    their positions; each area is exploded over the positions of the terms.
    """
    n = terms.count()
    spread = areas.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", F.pmod(F.col("a") + F.col("shift"), F.lit(n)))
    return spread.join(terms, "t").select("shift", "a", "area", "term").orderBy("shift", "a")


def lead_score(rating: Column, reviews: Column, phone: Column, state: Column, has_site: Column, sells_web: bool = False, weak_site: Column | None = None, email: Column | None = None) -> Column:
    """0 to 100: reachable, well rated and reviewed, in business, and the website signal. Who sells web services wants places without a site, or with a weak one."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    site = F.coalesce(has_site, F.lit(False))
    tests = [
        (filled(phone), 25), (F.coalesce(rating, F.lit(0.0)) >= 4.0, 20), (F.coalesce(reviews, F.lit(0)) >= 50, 15), (F.coalesce(state == "Operational", F.lit(False)), 10),
        (~site if sells_web else site, 30), (site & F.coalesce(weak_site, F.lit(False)) if sells_web and weak_site is not None else F.lit(False), 20), (filled(email) if email is not None else F.lit(False), 5),
    ]
    points = F.lit(0)
    for test, n in tests:
        points = points + F.when(test, n).otherwise(0)
    return F.least(points, F.lit(100))


def trust_score(host: Column, base: Column) -> Column:
    """Score of a site in [0, 1]: public bodies up, blogs down."""
    public = F.lit(0.0)
    for suffix in (".gov", ".gov.in", ".edu", ".ac.in", ".nic.in", ".int"):
        public = public + F.when(F.endswith(host, F.lit(suffix)), 0.15).otherwise(0.0)
    blog = F.when(host.rlike(r"(^|\.)(blogspot|wordpress|medium|substack)\.") | F.startswith(host, F.lit("blog.")), -0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + public + blog))


def equal_weights(tags: Column) -> Column:
    """Distinct tags, ignoring case, each with weight 1/n rounded to 4."""
    distinct = F.array_sort(F.array_distinct(F.transform(tags, F.lower)))
    return F.transform(distinct, lambda t: F.struct(t.alias("tag"), F.round(1 / F.size(distinct), 4).alias("weight")))
