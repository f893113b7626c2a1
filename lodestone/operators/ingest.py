"""Ingest: vocabulary loads, document checks, upserts, feeds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.windows import top_k
from lodestone.sources.schemas import TERM_STRUCT


# ---- vocabulary ------------------------------------------------------------------------

def load_vocabulary(df_json: DataFrame, value: str = "value") -> DataFrame:
    """Rows of JSON maps ``term:<term>:<category>`` -> fields; rows without a term are dropped."""
    m = df_json.select(F.explode(F.map_entries(F.from_json(value, f"map<string,{TERM_STRUCT}>"))).alias("e"))
    from_key = F.when(F.col("e.key").startswith("term:"), F.get(F.split("e.key", ":"), F.lit(1)))
    term = F.lower(X.strip(F.coalesce(X.blank_null(from_key), F.col("e.value.term"))))
    d = m.select(F.col("e.key").alias("key"), term.alias("term"), F.coalesce("e.value.display", term).alias("display"), "e.value.category",
                 "e.value.description", X.normalize_pos(F.col("e.value.pos")).alias("pos"),
                 X.ngram_type(term, F.col("e.value.entity_type")).alias("entity_type"), X.parse_rank(F.col("e.value.rank")).alias("rank"))
    return d.where(F.coalesce("term", F.lit("")) != "")


def add_terms(vocab: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vocabulary with the batch's new keys, and counts added / skipped per n-gram class."""
    b = batch.dropDuplicates(["key"])
    old = b.join(vocab.select("key"), "key", "left_semi")
    new = b.join(vocab.select("key"), "key", "left_anti")
    kind = X.ngram_type(F.col("term")).alias("ngram_type")
    stats = new.select(F.lit("added").alias("outcome"), kind).unionByName(old.select(F.lit("skipped").alias("outcome"), kind)) \
        .groupBy("outcome", "ngram_type").agg(F.count("*").alias("n"))
    return vocab.unionByName(new), stats


def ingest_vocab_chunks(chunks: DataFrame, value: str = "value", order: str = "chunk") -> DataFrame:
    """All chunk rows as one vocabulary; a key repeated in a later chunk wins."""
    d = load_vocabulary_with(chunks, value, order)
    return d.groupBy("key").agg(F.max_by(F.struct(*[c for c in d.columns if c not in ("key", order)]), order).alias("r")).select("key", "r.*")


def load_vocabulary_with(chunks: DataFrame, value: str, keep: str) -> DataFrame:
    m = chunks.select(keep, F.explode(F.map_entries(F.from_json(value, f"map<string,{TERM_STRUCT}>"))).alias("e"))
    term = F.coalesce(X.blank_null(F.get(F.split("e.key", ":"), F.lit(1))), F.col("e.value.term"))
    return m.select(keep, F.col("e.key").alias("key"), term.alias("term"), "e.value.category", X.parse_rank(F.col("e.value.rank")).alias("rank")) \
        .where(F.coalesce("term", F.lit("")) != "")


# ---- document checks ---------------------------------------------------------------------

@dataclass(frozen=True)
class DocumentRules:
    """Checks of a document batch; every broken one adds its name to the reasons."""
    required: dict = field(default_factory=lambda: {  # field -> largest length
        "document_title": 500, "document_summary": 10000, "document_category": 100, "document_data_type": 50,
        "document_schema": 50, "document_url": 2000})
    optional: dict = field(default_factory=lambda: {
        "document_uuid": 255, "semantic_uuid": 255, "cluster_uuid": 255, "document_author": 255, "document_brand": 255,
        "published_date_string": 50, "location_city": 100, "location_state": 100, "location_country": 100, "location_region": 100,
        "location_address": 500, "time_context": 100, "status": 50, "service_phone": 50})
    urls: tuple = ("document_url",)
    list_sizes: dict = field(default_factory=lambda: {"primary_keywords": (1, 10), "location_geopoint": (2, 2),
                                                      "location_coordinates": (2, 2)})
    item_lengths: dict = field(default_factory=lambda: {"primary_keywords": 100, "keywords": 100, "semantic_keywords": 100,
                                                        "key_passages": 2000, "entity_names": 255, "service_type": 100})
    ranges: dict = field(default_factory=lambda: {"authority_score": (0, 100), "service_rating": (0, 5), "media_rating": (0, 10)})
    choices: dict = field(default_factory=lambda: {"temporal_relevance": ["current", "historical", "timeless"]})
    schema: str | None = None
    default_type: str | None = None


NEWS = DocumentRules(schema="news", default_type="article", choices={
    "temporal_relevance": ["current", "historical", "timeless"],
    "document_category": ["national", "politics", "business", "sports", "entertainment", "opinion", "local", "technology", "health",
                          "science", "world"],
    "document_data_type": ["article", "video", "podcast", "opinion", "analysis"]})
RULES = {"news": NEWS, **{s: DocumentRules(schema=s) for s in ("business", "community", "health", "culture")}}
URL_FORM = r"^https?://[^\s/?#]+\.[^\s/?#]+([/?#]\S*)?$"


def check_documents(df: DataFrame, rules: DocumentRules | None = None, schema: str | None = None) -> DataFrame:
    """Every row with ``errors``, the rules it breaks, in one pass; a row without one is accepted."""
    r = rules or (RULES[schema] if schema else DocumentRules())
    if r.default_type and "document_data_type" in df.columns:
        df = df.withColumn("document_data_type", F.coalesce(X.blank_null(F.col("document_data_type")), F.lit(r.default_type)))
    have, bad = set(df.columns), []

    def rule(name: str, cond: Column) -> None:
        bad.append(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)))

    for f, n in r.required.items():
        if f not in have:
            bad.append(F.lit(f"{f} required"))
            continue
        rule(f"{f} required", F.coalesce(X.strip(F.col(f)), F.lit("")) == "")
        rule(f"{f} longer than {n}", F.length(f) > n)
    for f, n in r.optional.items():
        if f in have:
            rule(f"{f} longer than {n}", F.length(f) > n)
    for f in r.urls:
        if f in have:
            rule(f"{f} not a URL", (F.coalesce(F.col(f), F.lit("")) != "") & ~F.col(f).rlike(URL_FORM))
    for f, (lo, hi) in r.list_sizes.items():
        if f in have:
            rule(f"{f} size", ~F.size(f).between(lo, hi))
            if lo == 1:
                rule(f"{f} required", F.col(f).isNull())
    for f, n in r.item_lengths.items():
        if f in have:
            rule(f"{f} item longer than {n}", F.exists(f, _longer(n)))
    for f, (lo, hi) in r.ranges.items():
        if f in have:
            rule(f"{f} out of range", ~F.col(f).between(lo, hi))
    for f, vals in r.choices.items():
        if f in have:
            rule(f"{f} not allowed", (F.coalesce(F.col(f), F.lit("")) != "") & ~F.col(f).isin(vals))
    if r.schema and "document_schema" in have:
        rule(f"document_schema must be {r.schema}", F.col("document_schema") != r.schema)
    return df.withColumn("errors", F.array_compact(F.array(*bad)))


def validate_documents(df: DataFrame, rules: DocumentRules | None = None, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``errors``), for callers that send the two different ways; each is a pass of its own."""
    d, r = check_documents(df, rules, schema), rules or (RULES[schema] if schema else DocumentRules())
    ok = d.where(F.size("errors") == 0).drop("errors")
    return (ok.withColumn("document_schema", F.lit(r.schema)) if r.schema else ok), d.where(F.size("errors") > 0)


def _longer(n: int):
    return lambda x: F.length(x) > n


def fill_document_defaults(df: DataFrame, now: Column | None = None, stable_from: list[str] | None = None) -> DataFrame:
    """Missing document_uuid and created_at filled; ``id`` is the document_uuid.

    ``stable_from`` derives the identity from columns, so a repeated load
    gives the same id.
    """
    have = set(df.columns)
    made = F.md5(F.concat_ws("|", *stable_from)) if stable_from else F.uuid()
    uid = X.blank_null(F.col("document_uuid")) if "document_uuid" in have else F.lit(None)
    created = F.col("created_at") if "created_at" in have else F.lit(None)
    d = df.withColumns({"document_uuid": F.coalesce(uid, made),
                        "created_at": F.coalesce(created, F.unix_timestamp() if now is None else now)})
    return d.withColumn("id", F.col("document_uuid"))


def prune_empty(df: DataFrame) -> DataFrame:
    """Empty strings and empty lists become null."""
    def clean(name: str, typ: str) -> Column:
        if typ == "string":
            return X.blank_null(F.col(name))
        return F.when(F.size(name) > 0, F.col(name)) if typ.startswith("array") else F.col(name)
    return df.select(*[clean(n, t).alias(n) for n, t in df.dtypes])


def import_report(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Received, validated, imported, failed and the status per batch key, from rows with their ``errors``."""
    good, n = F.count_if(F.size("errors") == 0), F.count("*")
    status = F.when(good == n, "created").when(good > 0, "partial").otherwise("bad request")
    return checked.groupBy(*keys).agg(n.alias("total_received"), good.alias("validated"), good.alias("imported"), (n - good).alias("failed"),
                                      status.alias("status"))


# ---- table changes ------------------------------------------------------------------------

def upsert(base: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins; partial maxima before the shuffle."""
    u = base.unionByName(updates)
    rest = [c for c in u.columns if c != key]
    return u.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def delete_by_id(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return base.join(ids.select(key), key, "left_anti")


def fetch_by_ids(docs: DataFrame, wanted: DataFrame, key: str = "document_uuid") -> DataFrame:
    """Requested documents with their request and place in it (qid, pos, id)."""
    return wanted.join(docs, key)


# ---- feeds ---------------------------------------------------------------------------------

FEED_FIELDS = {
    "videos": "title:string,url:string,channel:string,image:string", "nonprofits": "title:string,url:string,image:string",
    "products": "title:string,url:string,price:double,image:string", "news": "title:string,url:string,source:string",
    "facts": "title:string,url:string",
}


def load_feed(df_json: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """Items of JSON arrays whose URL is empty or http(s)."""
    d = df_json.select(*[c for c in df_json.columns if c != value],
                       F.posexplode(F.from_json(value, f"array<struct<{FEED_FIELDS[kind]}>>")).alias("item_no", "i"))
    return d.select(*[c for c in d.columns if c != "i"], "i.*").where(F.coalesce("url", F.lit("")).rlike(r"^(https?://|$)"))


def dedupe_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return top_k(df, [key], order, 1)
