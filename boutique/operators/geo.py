"""Geolocation lookups: distinct lists (D1-D3, D7), autocomplete (D6, T5), search (F13),
membership flags (J15) and enrichment (J16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutique import constants as K
from boutique.functions.text import contains
from boutique.sources.tables import Tables


def distinct_values(df: DataFrame, col: str, as_string: bool = False) -> DataFrame:
    """Sorted distinct non-null values of one column (zip codes sort as strings)."""
    c = F.col(col).cast("string") if as_string else F.col(col)
    return df.select(c.alias(col)).dropna().distinct().orderBy(col)


def distinct_cities(t: Tables) -> DataFrame:
    return distinct_values(t.geolocation, "city")


def distinct_states(t: Tables) -> DataFrame:
    return distinct_values(t.geolocation, "state")


def distinct_zips(t: Tables) -> DataFrame:
    return distinct_values(t.geolocation, "zip_code_prefix", as_string=True)


def autocomplete(t: Tables, col: str, query: str | None, limit: int = K.AUTOCOMPLETE_LIMIT) -> DataFrame:
    """D6 + T5: sorted distinct values containing ``query`` as a literal substring
    (case-insensitive except for zip codes), first ``limit`` of them."""
    is_zip = col == "zip_code_prefix"
    df = distinct_values(t.geolocation, col, as_string=is_zip)
    q = (query or "").strip()
    if q:
        hit = F.col(col).contains(q) if is_zip else F.lower(F.col(col)).contains(q.lower())
        df = df.filter(hit)
    return df.orderBy(col).limit(limit)


def geo_search(t: Tables, query: str | None = None, limit: int = K.AUTOCOMPLETE_LIMIT) -> DataFrame:
    """Distinct (zip, city, state) rows where any of the three contains the
    pattern (case-insensitive), first ``limit`` by zip, city, state."""
    g = t.geolocation.select(
        F.col("zip_code_prefix").cast("string").alias("zip_code_prefix"), "city", "state"
    )
    q = (query or "").strip().lower()
    if q:
        g = g.filter(contains("zip_code_prefix", q) | contains("city", q) | contains("state", q))
    return g.distinct().orderBy("zip_code_prefix", "city", "state").limit(limit)


def geo_flags(rows: DataFrame, geo: DataFrame, zip_col="zip_code_prefix", city_col="city",
              state_col="state") -> DataFrame:
    """Three independent membership flags (zip exact; city and state case-insensitive).

    A blank or null input passes; an empty geolocation table lets everything pass. The
    lookups are distinct key sets joined on equality (no per-row scans of the table).
    """
    zips = geo.select(F.col("zip_code_prefix").alias("_gz"), F.lit(True).alias("_zip_hit")).distinct()
    cities = geo.select(F.lower("city").alias("_gc"), F.lit(True).alias("_city_hit")).dropna().distinct()
    states = geo.select(F.lower("state").alias("_gs"), F.lit(True).alias("_state_hit")).dropna().distinct()
    geo_empty = ~geo.select(F.lit(1)).exists()
    z = F.trim(F.col(zip_col).cast("string"))
    c = F.trim(F.col(city_col))
    s = F.trim(F.col(state_col))
    df = (
        rows.withColumn("_z", z.try_cast("int"))
        .withColumn("_c", F.lower(c))
        .withColumn("_s", F.lower(s))
        .join(zips, F.col("_z") == F.col("_gz"), "left")
        .join(cities, F.col("_c") == F.col("_gc"), "left")
        .join(states, F.col("_s") == F.col("_gs"), "left")
    )

    def blank(x):
        return x.isNull() | (x == "")

    return df.select(
        *rows.columns,
        (geo_empty | blank(z) | F.coalesce("_zip_hit", F.lit(False))).alias("zip_ok"),
        (geo_empty | blank(c) | F.coalesce("_city_hit", F.lit(False))).alias("city_ok"),
        (geo_empty | blank(s) | F.coalesce("_state_hit", F.lit(False))).alias("state_ok"),
    )


def geo_enrich(rows: DataFrame, geo: DataFrame) -> DataFrame:
    """City and state looked up from the zip (exact), and zip and state looked up
    from the city (case-insensitive, first match by zip)."""
    by_zip = geo.groupBy("zip_code_prefix").agg(
        F.min_by(F.struct("city", "state"), F.struct("city", "state")).alias("_zv")
    ).select(
        F.col("zip_code_prefix").alias("_ez"),
        F.col("_zv.city").alias("city_from_zip"),
        F.col("_zv.state").alias("state_from_zip"),
    )
    by_city = (
        geo.filter(F.col("city").isNotNull())
        .groupBy(F.lower("city").alias("_ec"))
        .agg(F.min(F.struct("zip_code_prefix", "state")).alias("_cv"))
        .select("_ec", F.col("_cv.zip_code_prefix").alias("zip_from_city"),
                F.col("_cv.state").alias("state_from_city"))
    )
    return (
        rows.join(by_zip, F.col("zip_code_prefix") == F.col("_ez"), "left")
        .join(by_city, F.lower(F.trim("city")) == F.col("_ec"), "left")
        .drop("_ez", "_ec")
    )
