"""Row enrichment jobs: locations and result records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.windows import carry_forward
from lodestone.rules import fixed as R


def resolve_location(df: DataFrame) -> DataFrame:
    """Location of each event, field by field.

    Order: fields given with the event, the last fields given earlier in the
    session, the country header, the looked-up address.
    Needs event_id, ts, session_id, url_city, url_country, header_country,
    ip_city, ip_country.
    """
    cap = df.withColumn("given", F.when(
        F.coalesce("url_city", "url_country").isNotNull(),
        F.struct(F.substring("url_city", 1, 100).alias("city"), F.substring("url_country", 1, 100).alias("country"))))
    d = carry_forward(cap, ["session_id"], "ts", "event_id", ["given"])
    code = F.when(~F.col("header_country").isin(R.UNKNOWN_COUNTRY_CODES), F.col("header_country"))
    city, country = F.col("seen_given")["city"], F.col("seen_given")["country"]
    lookup = city.isNull()
    return d.withColumns({
        "city": F.coalesce(city, "ip_city"),
        "country": F.coalesce(country, F.when(lookup, F.col("ip_country"))),
        "country_code": code}).drop("given", "seen_given")


RESULT_TEXT = ["document_title", "document_summary", "document_url", "document_brand", "document_category",
               "document_data_type", "document_schema", "primary_subject_name", "primary_subject_type",
               "primary_subject_confidence", "primary_subject_disambiguator", "location_city", "location_state",
               "location_country", "location_region", "location_address", "time_context", "cluster_uuid",
               "semantic_uuid", "published_date_string", "service_price_range", "service_phone", "service_hours"]
RESULT_LISTS = ["image_url", "logo_url", "key_facts", "secondary_subjects", "service_type", "service_specialties"]


def format_results(df: DataFrame) -> DataFrame:
    """Documents as result records: renamed, defaulted, places and times nested."""
    have = set(df.columns)

    def s(name: str, default: str | None = ""):
        c = F.col(name) if name in have else F.lit(None).cast("string")
        return c if default is None else F.coalesce(X.blank_null(c), F.lit(default))

    def lst(name: str):
        empty = F.array().cast("array<string>")
        return F.coalesce(F.col(name), empty) if name in have else empty

    def num(name: str, typ: str):
        return F.col(name).cast(typ) if name in have else F.lit(None).cast(typ)

    def flag(name: str):
        return F.coalesce(F.col(name), F.lit(False)) if name in have else F.lit(False)

    brand = F.col("document_brand") if "document_brand" in have else F.col("source") if "source" in have else F.lit(None)
    lat = F.col("location_geopoint")["lat"] if "location_geopoint" in have else F.lit(None).cast("double")
    lng = F.col("location_geopoint")["lng"] if "location_geopoint" in have else F.lit(None).cast("double")
    date = X.format_date(s("published_date_string"))
    semantic = 1 - F.col("vector_distance") if "vector_distance" in have else F.lit(0.0)
    authority = "authority_score" if "authority_score" in have else "authority_rank_score"
    return df.select(
        F.col("document_uuid").alias("id"), s("document_title", "Untitled").alias("title"),
        lst("image_url").alias("image_url"), lst("logo_url").alias("logo_url"),
        s("document_title").alias("title_highlighted"), s("document_summary").alias("summary"),
        s("document_summary").alias("summary_highlighted"), s("document_url").alias("url"),
        F.coalesce(brand, F.lit("unknown")).alias("source"), F.coalesce(brand, F.lit("Website")).alias("site_name"),
        F.get(lst("image_url"), F.lit(0)).alias("image"), s("document_category").alias("category"),
        s("document_data_type").alias("data_type"), s("document_schema").alias("schema"),
        date.alias("date"), date.alias("published_date"),
        F.coalesce(num(authority, "double"), F.lit(0.0)).alias("authority_score"),
        s("cluster_uuid", None).alias("cluster_uuid"), s("semantic_uuid", None).alias("semantic_uuid"),
        lst("key_facts").alias("key_facts"), F.lit("").alias("humanized_summary"),
        F.array_join(lst("key_facts"), " ").alias("key_facts_highlighted"), semantic.alias("semantic_score"),
        flag("black_owned").alias("black_owned"), flag("women_owned").alias("women_owned"),
        s("primary_subject_name").alias("primary_subject_name"), s("primary_subject_type").alias("primary_subject_type"),
        s("primary_subject_confidence").alias("primary_subject_confidence"),
        s("primary_subject_disambiguator").alias("primary_subject_disambiguator"),
        lst("secondary_subjects").alias("secondary_subjects"),
        num("service_rating", "double").alias("service_rating"),
        num("service_review_count", "bigint").alias("service_review_count"),
        lst("service_type").alias("service_type"), lst("service_specialties").alias("service_specialties"),
        s("service_price_range", None).alias("service_price_range"), s("service_phone", None).alias("service_phone"),
        s("service_hours", None).alias("service_hours"),
        F.struct(s("location_city", None).alias("city"), s("location_state", None).alias("state"),
                 s("location_country", None).alias("country"), s("location_region", None).alias("region"),
                 s("location_address", None).alias("address"), lat.alias("lat"), lng.alias("lng")).alias("location"),
        F.struct(num("time_period_start", "int").alias("start"), num("time_period_end", "int").alias("end"),
                 s("time_context", None).alias("context")).alias("time_period"),
        F.lit(0.5).alias("score"), F.array().cast("array<string>").alias("related_sources"))
