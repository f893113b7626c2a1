"""Declared schemas of the content tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: document fields; first column type, then facet / optional / unindexed flags ---
_FIELDS = {
    "string": "document_uuid semantic_uuid cluster_uuid document_summary document_url",
    "string facet": "document_title document_category document_data_type document_schema",
    "string facet optional": "time_context temporal_relevance location_city location_state location_country location_region "
                             "document_author document_brand product_currency product_category person_gender person_race "
                             "media_author_creator media_release_date media_language status",
    "string optional": "location_address published_date_string person_full_name person_birth_date media_duration service_phone",
    "array<string> facet": "primary_keywords keywords semantic_keywords",
    "array<string> facet optional": "entity_names product_features person_positions media_genre service_type service_specialties",
    "array<string> optional": "image_url video_url logo_url social_media key_passages person_education person_achievements",
    "int optional": "time_period_start time_period_end content_depth",
    "bigint": "created_at",
    "bigint optional": "published_date",
    "double optional": "authority_score product_price product_rating media_rating service_rating rating",
    "boolean facet optional": "product_available black_owned",
    "struct<lat:double,lng:double> optional": "location_geopoint location_coordinates",
    # fields used when scoring
    "string facet optional scoring": "primary_subject_name primary_subject_type primary_subject_confidence content_intent",
    "array<string> optional scoring": "key_facts topic_tags secondary_subjects",
    "double optional scoring": "authority_rank_score factual_density_score content_depth_score evergreen_score subtopic_richness "
                               "concept_count word_count service_review_count product_review_count recipe_rating recipe_review_count",
    "array<float> optional": "embedding",
}


def document_schema() -> T.StructType:
    out = []
    for spec, names in _FIELDS.items():
        typ, *flags = spec.split()
        for n in names.split():
            meta = {"facet": "facet" in flags, "mandatory": "optional" not in flags, "scoring": "scoring" in flags}
            out.append(T.StructField(n, T.StructType.fromDDL(f"x {typ}")[0].dataType, True, meta))
    return T.StructType(out)


QUESTION_DDL = ("question_id string, document_uuid string, question string, answer string, answer_type string, question_type string, "
                "primary_keywords array<string>, entities array<string>, semantic_keywords array<string>, embedding array<float>")
VOCAB_DDL = ("key string, term string, display string, category string, description string, pos string, entity_type string, rank bigint")
TERM_STRUCT = "struct<term:string,display:string,category:string,description:string,pos:string,entity_type:string,rank:string>"
PROFILE_DDL = {
    "business": "business_name string, business_website string, latitude decimal(9,6), longitude decimal(9,6), categories string",
    "user": "user_id bigint, username string, email string, city string",
    "session": "session_key string, user_id bigint, ip string, created timestamp",
    "preference": "user_id bigint, settings string",
    "subscriber": "email string, subscribed timestamp, active boolean",
}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(document_schema()).parquet(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION_DDL).parquet(path)


def read_profiles(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Account tables as dimensions; JSON columns become maps or lists."""
    d = spark.read.schema(PROFILE_DDL[kind]).parquet(path)
    if kind == "business":
        d = d.withColumn("categories", F.from_json("categories", "array<string>"))
    if kind == "preference":
        d = d.withColumn("settings", F.from_json("settings", "map<string,string>"))
    return d


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame with exactly the declared columns and types; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
