"""Retrieval: keywords, vectors, filters, merges and related sets.

Keyword retrieval needs every query token in the document. Only the rarest
token of a query reads its blocks of the index; the others are probed for the
documents found. Distinct token sets are searched once, however often asked.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import index as IX
from lodestone.operators import vectors as VX
from lodestone.operators import vocab as V
from lodestone.operators.facets import lookup
from lodestone.operators.index import postings  # noqa: F401
from lodestone.operators.windows import spread, top_k
from lodestone.rules import scoring as R
from lodestone.session import looked_up, materialize

#: Documents offered for a query without a token, a list of its own.
BROWSE_LIST = 100
#: Queries of a token set whose rows lie together; a set that more queries ask for has several lots.
LOT = 64


# ---- keyword retrieval --------------------------------------------------------------

def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, tokens, token_key): ordered distinct tokens; the key names the token set."""
    return (queries.select("query_id", X.match_tokens(F.col("query")).alias("tokens"))
            .withColumn("token_key", F.array_join(F.array_sort("tokens"), " ")))


def keyword_candidates(queries: DataFrame, docs: DataFrame, k: int | None = None, num_typos: int = 0,
                       drop_tokens: int | str | None = None, post: DataFrame | None = None, browse: int = BROWSE_LIST, index: IX.KeywordIndex | None = None,
                       fields: bool = False, hits: DataFrame | None = None, carry: DataFrame | None = None) -> DataFrame:
    """(query_id, document_uuid, text_match, candidate_rank): all documents of each query, or its best k.

    Order: summed weight, authority, id. A query without tokens takes the
    ``browse`` documents of highest authority. ``drop_tokens`` is the number of hits below
    which trailing tokens are dropped, or a column of ``queries`` that holds it; ``num_typos`` allows one edit per token.
    ``index`` is a built index of ``docs``; without one it is made for this call, from ``post`` if given.
    With ``fields`` each row also has the bits of the fields that hold its tokens.
    ``hits`` are ``all_hits`` of the queries' token sets, where a job has them already.
    Rows take the columns of their query in ``carry`` (query_id, ...) along; where each
    query asks for one set they then also have its ``token_key`` and ``lot``, by which
    they lie: what is done by these and the query moves no row.
    """
    index = IX.build(docs, post=post) if index is None else index
    q = materialize(query_tokens(queries), "query-tokens")
    variants = None
    if num_typos:
        asked = q.select(F.explode("tokens").alias("word")).distinct()
        near = V.near_terms(asked, index.heads.select(F.col("token").alias("term")), 1)
        variants = near.select(F.col("word").alias("token"), F.col("term").alias("alt"))
    auth = docs.select("document_uuid", F.col("authority_rank_score").alias("_a"))
    order = [F.desc("text_match"), F.desc("_a"), F.asc("document_uuid")]
    if hits is not None:
        pass
    elif k is not None and not num_typos and not drop_tokens:
        hits = IX.best_hits(q, index, k)
    else:
        hits = materialize(IX.all_hits(q, index, variants), "hits") if drop_tokens else IX.all_hits(q, index, variants)
    hits = hits.withColumnRenamed("authority", "_a")
    least = F.lit(drop_tokens) if isinstance(drop_tokens, int) else F.lit(0) if drop_tokens is None else F.col("least")
    keys = q.select("query_id", "token_key", "tokens")
    if isinstance(drop_tokens, str):
        keys = keys.join(queries.select("query_id", F.col(drop_tokens).alias("least")), "query_id")
    held = ["least"] if isinstance(drop_tokens, str) else []
    if drop_tokens:
        # only sets with too few hits are searched again, by their leading tokens
        n = hits.groupBy("token_key").agg(F.count("*").alias("n"))
        few = keys.where(F.size("tokens") > 1).join(n, "token_key", "left").where(F.coalesce("n", F.lit(0)) < least)
        heads = few.select("query_id", *held, F.posexplode(F.transform(
            F.sequence(F.lit(1), F.size("tokens") - 1), lambda m: F.array_join(F.array_sort(F.slice("tokens", 1, m)), " "))).alias("m", "token_key"))
        more = IX.all_hits(heads, index, variants).withColumnRenamed("authority", "_a")
        cnt = more.groupBy("token_key").agg(F.count("*").alias("n"))
        level = (heads.join(cnt, "token_key").withColumn("ok", F.col("n") >= least).groupBy("query_id")
                 .agg(F.max_by("token_key", F.struct("ok", F.when(F.col("ok"), F.col("m")).otherwise(-F.col("m")))).alias("token_key")))
        kept = keys.join(level.select("query_id"), "query_id", "left_anti").select("query_id", "token_key")
        parts = [(kept, hits), (level, more)]
    else:
        parts = [(keys.select("query_id", "token_key"), hits)]
    # queries without a token share one list of at most ``browse`` rows
    star = keys.where(F.col("token_key") == "").select("query_id", "token_key")
    head = auth.orderBy(F.desc("_a"), F.asc("document_uuid")).limit(browse).withColumns(
        {"token_key": F.lit(""), "text_match": F.lit(0).cast("bigint"), "fields": F.array().cast("array<int>")})
    out = ["query_id", "document_uuid", "text_match", *(["fields"] if fields else []), "candidate_rank"]
    taken = [] if carry is None else [c for c in carry.columns if c != "query_id"]
    # a query that asks for one set has the ranks of that set, so the rows are ranked before they are dealt to the queries
    one_set = q.groupBy("query_id").count().where(F.col("count") > 1).isEmpty()
    best = (lambda h: top_k(h, ["token_key"], order, k, rank="candidate_rank")) if one_set else (lambda h: top_k(h, ["token_key"], order, k))
    if one_set and carry is not None and not drop_tokens:
        asked = keys.select("query_id", "token_key")
        every = hits.select("token_key", *head.columns[:2], "text_match", "fields").unionByName(head.select("token_key", *head.columns[:2], "text_match", "fields"))
        busy = materialize(asked.groupBy("token_key").agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias("_lots")).where(F.col("_lots") > 1), "busy-sets")
        if busy.isEmpty():
            asked, every = asked.withColumn("lot", F.lit(0)), every.withColumn("lot", F.lit(0))
        else:
            lots = F.coalesce("_lots", F.lit(1))
            asked = asked.join(busy, "token_key", "left").withColumn("lot", F.pmod(F.hash("query_id"), lots)).drop("_lots")
            every = every.join(busy, "token_key", "left").withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1))).drop("_lots")
        by = ["token_key", "lot"]
        return asked.join(carry, "query_id", "left").join(top_k(spread(every, *by), by, order, k, rank="candidate_rank"), by).select(*out, *taken, *by)
    rows = reduce(DataFrame.unionByName, [asked.join(best(h), "token_key") for asked, h in parts]).unionByName(star.join(F.broadcast(best(head)), "token_key"))
    if not one_set:
        rows = top_k(rows if fields else rows.drop("fields"), ["query_id"], order, k, rank="candidate_rank")
    return (rows if carry is None else rows.join(carry, "query_id", "left")).select(*out, *taken)


# --- fixed values: what a candidate carries on to scoring and display
METADATA = [
    "document_data_type", "document_category", "document_schema", "document_title", "content_intent",
    "primary_subject_name", "primary_subject_type", "primary_subject_confidence", "primary_subject_disambiguator", "secondary_subjects",
    "entity_names", "primary_keywords", "key_facts", "topic_tags", "semantic_keywords", "document_summary",
    "content_depth_score", "factual_density_score", "evergreen_score", "subtopic_richness", "concept_count", "authority_rank_score", "word_count",
    "authority_score", "service_rating", "service_review_count", "service_type", "product_rating", "product_review_count",
    "recipe_rating", "recipe_review_count", "media_rating", "black_owned", "image_url", "logo_url",
]


def attach_metadata(cands: DataFrame, docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Candidates with the metadata columns that the collection has, or the named ones."""
    if columns is not None:
        return cands.join(looked_up(docs.select("document_uuid", *columns), "metadata"), "document_uuid")
    return cands.join(docs.select("document_uuid", *[c for c in METADATA if c in docs.columns]), "document_uuid")


def place_filter(d: DataFrame) -> Column:
    """No places asked for, or one of the cities and one of the state variants."""
    city = (F.size("cities") == 0) | F.array_contains("cities", F.col("location_city"))
    state = (F.size("state_variants") == 0) | F.array_contains("state_variants", F.col("location_state"))
    return ~F.col("filters_place") | (city & state)


def apply_filters(cands: DataFrame, profile: DataFrame) -> DataFrame:
    """Place, scope and chosen filters of each query over its candidates.

    ``chosen_data_type``, ``chosen_category`` and ``chosen_schema`` are arrays
    where the profile has them; an empty one filters nothing. A query whose
    answer is a place (``where_answer``) is not restricted to places.
    """
    d = cands.join(profile, "query_id")
    place = place_filter(d)
    if "where_answer" in profile.columns:
        place = place | F.coalesce("where_answer", F.lit(False))
    scope = F.col("required_type").isNull() | (F.col("document_data_type") == F.col("required_type"))
    for name, field in (("chosen_data_type", "document_data_type"), ("chosen_category", "document_category"), ("chosen_schema", "document_schema")):
        if name in profile.columns:
            scope = scope & ((F.coalesce(F.size(name), F.lit(0)) <= 0) | F.array_contains(name, F.col(field)))
    return d.where(place & scope)


def expand_synonyms(words: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(…, word, is_synonym): the word and what its root also finds; never the reverse."""
    syn = synonyms.select(F.col("root").alias("word"), "synonym")
    more = words.join(syn, "word").withColumn("word", F.col("synonym")).drop("synonym")
    return words.withColumn("is_synonym", F.lit(False)).unionByName(more.withColumn("is_synonym", F.lit(True))).distinct()


# ---- vectors ---------------------------------------------------------------------------

QUERY_BLOCK, ITEM_BLOCK = 2048, 16384
#: Queries of a block whose distances are held at once.
QUERY_SLICE = 128


#: Values that round alike lie nearer than this.
ROUNDING = 2e-9


def block_topk(a: pd.DataFrame, b: pd.DataFrame, k: int | None, exclude_self: bool = False, lo: float | None = None, hi: float | None = None) -> pd.DataFrame:
    """(qid, iid, distance): the k nearest items of a block ``b`` (iid, ivec) for each query of a block ``a`` (qid, qvec).

    ``QUERY_SLICE`` queries at a time, so that the distances of a whole block are never held at once.
    Where ``a`` has ``tau``, the distance of a query's k-th hit so far, what lies beyond it is left out.
    Only distances that may be among the first k are rounded and sorted.
    """
    none = pd.DataFrame({"qid": pd.Series(dtype=str), "iid": pd.Series(dtype=str), "distance": pd.Series(dtype=float)})
    if a.empty or b.empty:
        return none
    order = np.argsort(b.iid.to_numpy(), kind="stable")
    ids_i, y = b.iid.to_numpy()[order], np.stack(b.ivec.to_numpy())[order].astype(np.float64)
    ny = np.linalg.norm(y, axis=1)
    ny[ny == 0] = 1
    if exclude_self:  # ids that stand on both sides, found once for the block
        own = pd.DataFrame({"id": a.qid.to_numpy(), "row": np.arange(len(a))}).merge(pd.DataFrame({"id": ids_i, "col": np.arange(len(b))}), on="id").sort_values("row")
        own_rows, own_cols = own.row.to_numpy(), own.col.to_numpy()

    def near_slice(start: int) -> pd.DataFrame:
        s = a.iloc[start:start + QUERY_SLICE]
        x, ids_q = np.stack(s.qvec.to_numpy()).astype(np.float64), s.qid.to_numpy()
        nx = np.linalg.norm(x, axis=1)
        d = x @ y.T
        d /= np.where(nx == 0, 1, nx)[:, None]
        d /= ny[None, :]
        np.subtract(1, d, out=d)
        if exclude_self:
            at = slice(*np.searchsorted(own_rows, [start, start + len(s)]))
            d[own_rows[at] - start, own_cols[at]] = np.inf
        if lo is not None and hi is not None:
            d[1 - d > hi] = np.inf
        if k is None:
            rows, cols = np.nonzero(np.isfinite(d) if lo is None else 1 - d >= lo)
        else:
            bound = s.tau.to_numpy(dtype=float, na_value=np.nan) if "tau" in s else np.full(len(s), np.nan)
            free = np.isnan(bound)
            if free.any() and k < d.shape[1]:
                bound = bound.copy()
                bound[free] = np.partition(d[free], k - 1, axis=1)[:, k - 1]
            rows, cols = np.nonzero(d <= np.where(np.isnan(bound), np.inf, bound)[:, None] + ROUNDING)
        v = d[rows, cols]
        ok = np.isfinite(v) if lo is None else np.isfinite(v) & (1 - v >= lo)
        rows, cols, v = rows[ok], cols[ok], np.round(v[ok], 9)
        if k is not None:
            by = np.lexsort((cols, v, rows))
            rows, cols, v = rows[by], cols[by], v[by]
            first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            rows, cols, v = rows[first], cols[first], v[first]
        return pd.DataFrame({"qid": ids_q[rows], "iid": ids_i[cols], "distance": v})

    return pd.concat([near_slice(i) for i in range(0, len(a), QUERY_SLICE)], ignore_index=True)


def vector_topk(queries: DataFrame, items: DataFrame, k: int | None, keyed: bool = False, exclude_self: bool = False,
                lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(qid, iid, distance, rank): exact k nearest items by cosine distance.

    queries: qid, qvec[, key]; items: iid, ivec[, key]. With ``keyed`` only
    equal keys meet; the key ``*`` stands for no filter. ``lo``/``hi`` keep
    similarities of that band; without ``k`` all of the band are returned.
    Items of a large key lie in cells round pivots, and a query meets only the
    cells that may hold one of its hits; one task multiplies one pair of blocks
    of bounded size and returns at most k rows a query. A vector of length zero
    is at distance 1 from every other; null vectors are in no result.
    """
    if not keyed:
        queries, items = queries.withColumn("key", F.lit("*")), items.withColumn("key", F.lit("*"))
    q = queries.select(F.col("qid").cast("string").alias("qid"), "qvec", "key").where(F.col("qvec").isNotNull())
    i = items.select(F.col("iid").cast("string").alias("iid"), "ivec", "key").where(F.col("ivec").isNotNull())
    # one row for each key that queries and items share
    sizes = materialize(i.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(q.select("key").distinct(), "key"), "vector-keys")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return block_topk(a, b, k, exclude_self, lo, hi)

    farthest = np.inf if lo is None else 1 - lo
    part = VX.nearest(q, i, k, sizes, best, QUERY_BLOCK, ITEM_BLOCK, farthest)
    return top_k(part, ["qid"], [F.asc("distance"), F.asc("iid")], k, rank="rank")


def relaxed_topk(queries: DataFrame, items: DataFrame, levels: list[str], k: int, least: int = 5) -> DataFrame:
    """k nearest under the strictest filter with enough items.

    ``levels`` are key columns on both sides, strictest first; the last resort
    is no filter. Level sizes are counted per key, so pairs are only formed
    for the chosen level.
    """
    q = queries
    for n, c in enumerate(levels):
        size = items.groupBy(c).agg(F.count("*").alias(f"_n{n}"))
        q = q.join(size, c, "left")
    key = reduce(lambda acc, nc: F.when(F.coalesce(f"_n{nc[0]}", F.lit(0)) >= least, F.concat(F.lit(f"{nc[0]}:"), F.col(nc[1]).cast("string")))
                 .otherwise(acc), reversed(list(enumerate(levels))), F.lit("*"))
    q = q.withColumn("key", key)
    keys = F.array(F.lit("*"), *[F.concat(F.lit(f"{n}:"), F.col(c).cast("string")) for n, c in enumerate(levels)])
    it = items.select("iid", "ivec", F.explode(keys).alias("key"))
    top = vector_topk(q.select("qid", "qvec", "key"), it, k, keyed=True)
    return top.join(q.select(F.col("qid").cast("string").alias("qid"), F.substring_index("key", ":", 1).alias("level")), "qid")


QUESTION_TYPES = {"when": "TEMPORAL", "where": "LOCATION", "who": "PERSON", "what": "FACTUAL", "which": "FACTUAL",
                  "why": "REASON", "how": "PROCESS"}


def question_filter(profile: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, question_id, reason): questions of one of the first three keywords or entities, or
    of the asked type, that lie in an asked place.

    profile: query_id, keywords, entities and, where there are any, question_word, cities and
    state_variants; questions: question_id, q_keywords, q_entities and question_type, location_city,
    location_state. Each alternative of the OR is an equi-join; without a place
    asked for, nothing is filtered by place.
    """
    p = profile
    for col in ("cities", "state_variants"):
        p = p if col in p.columns else p.withColumn(col, F.array().cast("array<string>"))
    q = questions
    for col in ("location_city", "location_state", "question_type"):
        q = q if col in q.columns else q.withColumn(col, F.lit(None).cast("string"))
    place, at = ["cities", "state_variants"], ["location_city", "location_state"]

    def side(values: Column, found: Column, reason: str) -> DataFrame:
        a = p.select("query_id", *place, F.explode(values).alias("v"))
        b = q.select("question_id", *at, F.explode(found).alias("v"))
        return a.join(b, "v").select("query_id", "question_id", *place, *at, F.lit(reason).alias("reason"))

    out = side(F.slice("keywords", 1, 3), F.array_distinct("q_keywords"), "keyword").unionByName(
        side(F.slice("entities", 1, 3), F.array_distinct("q_entities"), "entity"))
    if "question_word" in p.columns:
        asked = lookup(QUESTION_TYPES, F.lower("question_word"))
        out = out.unionByName(side(F.array_compact(F.array(asked)), F.array_compact(F.array("question_type")), "type"))
    ok = [(F.size(c) == 0) | F.coalesce(F.array_contains(c, F.col(f)), F.lit(False)) for c, f in zip(place, at)]
    return out.where(ok[0] & ok[1]).select("query_id", "question_id", "reason").distinct()


def validate_question_hits(hits: DataFrame) -> DataFrame:
    """Hits below the distance gate whose words support the query.

    Needs distance, q_tokens, q_phrases, q_subject, c_tokens, c_phrases and
    location_tokens. Adds match_count and subject_hit, keeps the valid rows.
    """
    c = F.col
    exact = F.array_intersect("q_tokens", "c_tokens")
    part = F.filter(F.array_except("q_tokens", "c_tokens"), lambda q: F.exists("c_tokens", lambda x: x.contains(q) | q.contains(x)))
    phrases = F.filter("q_phrases", lambda p: (F.length(p) >= 3) & (
        F.array_join("c_phrases", " ").contains(p) | F.exists("c_phrases", lambda x: x.contains(p) | p.contains(x))))
    d = hits.where(c("distance") < R.QUESTION_GATE).withColumns({"_e": exact, "_p": part, "_f": phrases})
    d = d.withColumns({
        "match_count": F.size("_e") + F.size("_p") + F.size("_f"),
        "subject_hit": F.arrays_overlap("q_subject", F.col("_e")) | F.arrays_overlap("q_subject", F.col("_p"))
        | F.exists("_f", lambda p: F.arrays_overlap(F.col("q_subject"), X.signal_tokens(p)))})
    ok = (F.size("q_tokens") == 0) | ((F.size("c_tokens") > 0) & (c("match_count") >= 1)
                                      & ((F.size("q_subject") == 0) | (F.size("q_tokens") < 3) | c("subject_hit")))
    place = (F.size("location_tokens") == 0) | F.arrays_overlap("location_tokens", "c_tokens")
    return d.where(ok & place).drop("_e", "_p", "_f")


# ---- merge and rerank -----------------------------------------------------------------------

def merge_candidates(kw: DataFrame, qn: DataFrame, k: int | None = None) -> DataFrame:
    """Documents of both lists first, then keyword only, then question only."""
    a = kw.select("query_id", "document_uuid", F.col("candidate_rank").alias("kr"))
    b = qn.groupBy("query_id", "document_uuid").agg(F.min("candidate_rank").alias("qr"))
    m = a.join(b, ["query_id", "document_uuid"], "full_outer")
    both = F.col("kr").isNotNull() & F.col("qr").isNotNull()
    m = m.withColumn("source", F.when(both, 0).when(F.col("kr").isNotNull(), 1).otherwise(2))
    return top_k(m, ["query_id"], [F.asc("source"), F.asc(F.coalesce("kr", "qr")), F.asc("document_uuid")], k, rank="candidate_rank") \
        .drop("kr", "qr")


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _length(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine_distance(a: Column, b: Column, length_a: Column | None = None, length_b: Column | None = None) -> Column:
    """Null where a vector is null or has no length; the lengths may be given, where a vector meets many others."""
    n = (_length(a) if length_a is None else length_a) * (_length(b) if length_b is None else length_b)
    return F.when(a.isNotNull() & b.isNotNull() & (n > 0), 1 - _dot(a, b) / n)


def query_side(query_vectors: DataFrame) -> DataFrame:
    """(query_id, query_embedding, _lb): the vectors of queries with their lengths, for candidates to ``carry``."""
    b = F.col("query_embedding")
    return query_vectors.select("query_id", b, _length(b).alias("_lb"))


def rerank(cands: DataFrame, doc_vectors: DataFrame, query_vectors: DataFrame, max_k: int | None = None) -> DataFrame:
    """Adds vector_distance and semantic_rank; unknown vectors get 1.0 and go last.

    With ``max_k`` only the first candidates of a query are ordered by vector;
    the others follow in the order they had. Candidates that carry the
    ``query_side`` of the vectors do not meet them again, and where they lie
    by token set and lot they are ranked there.
    """
    a, b = F.col("embedding"), F.col("query_embedding")
    items = looked_up(doc_vectors.select("document_uuid", a, _length(a).alias("_la")), "document-vectors")
    c = cands if "_lb" in cands.columns else cands.join(query_side(query_vectors), "query_id", "left")
    c = c.join(items, "document_uuid", "left")
    d = F.coalesce(F.round(cosine_distance(a, b, F.col("_la"), F.col("_lb")), 9), F.lit(1.0))
    c = c.withColumn("vector_distance", d).drop("embedding", "query_embedding", "_la", "_lb")
    order = [F.asc("vector_distance"), F.asc("candidate_rank"), F.asc("document_uuid")]
    if max_k is not None:
        late = F.col("candidate_rank") > max_k
        order = [late.asc(), F.when(~late, F.col("vector_distance")).asc(), *order[1:]]
    lies = [x for x in ("token_key", "lot") if x in c.columns]
    if not lies:
        return top_k(c, ["query_id"], order, None, rank="semantic_rank")
    # the number keeps the queries of a task apart at the first look
    c = top_k(c.withColumn("_query", F.xxhash64("query_id")), ["_query", *lies, "query_id"], order, None, rank="semantic_rank")
    return c.drop("_query", *lies)


def prune_by_distance(df: DataFrame, mode: str = "query_mode") -> DataFrame:
    lim = F.coalesce(lookup(R.DISTANCE_LIMITS, F.col(mode)), F.lit(R.DEFAULT_DISTANCE_LIMIT))
    return df.where(F.col("vector_distance") <= lim)


def apply_rank(results: DataFrame, ranked: DataFrame, k: int | None = None) -> DataFrame:
    """Semantic rank and distance joined in; rows without one go last; renumbered."""
    r = ranked.select("query_id", "document_uuid", "semantic_rank", "vector_distance")
    d = results.join(r, ["query_id", "document_uuid"], "left").withColumns({
        "semantic_rank": F.coalesce("semantic_rank", F.lit(999999)), "vector_distance": F.coalesce("vector_distance", F.lit(1.0))})
    return top_k(d, ["query_id"], [F.asc("semantic_rank"), F.asc("document_uuid")], k, rank="rank")


# ---- related sets --------------------------------------------------------------------------------

def same_group(docs: DataFrame, seeds: DataFrame, key: str, k: int, order: list[Column] | None = None,
               id_col: str = "document_uuid", columns: list[str] = ()) -> DataFrame:
    """(seed_id, id, rank): the k best documents sharing the seed's key, without itself.

    Only the k+1 best documents of a group can appear, so those are found
    first; a group with a third of all documents still offers k+1 rows.
    """
    order = order or [F.desc("authority_rank_score"), F.asc(id_col)]
    g = docs.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    best = top_k(g, [key], order, k + 1)
    s = seeds.select(F.col(id_col).alias("seed_id"), key)
    return top_k(s.join(best, key).where(F.col("seed_id") != F.col(id_col)), ["seed_id"], order, k, rank="rank") \
        .select("seed_id", id_col, "rank", key, *columns)


def cluster_members(docs: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Documents of the seed's range ``p-c-0000`` .. ``p-c-9999``, in id order.

    The range is an equality on the first two parts of the id.
    """
    def part(c): return F.substring_index(c, "-", 2)
    d = docs.withColumn("_c", part("semantic_uuid"))
    best = top_k(d, ["_c"], [F.asc("semantic_uuid"), F.asc("document_uuid")], k + 1)
    s = seeds.select(F.col("document_uuid").alias("seed_id"), part("semantic_uuid").alias("_c"))
    return top_k(s.join(best, "_c").where(F.col("seed_id") != F.col("document_uuid")), ["seed_id"],
                 [F.asc("semantic_uuid"), F.asc("document_uuid")], k, rank="rank").select("seed_id", "document_uuid", "semantic_uuid", "rank")


def similar_documents(docs: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Cluster members first, filled up with nearest vectors."""
    cl = cluster_members(docs, seeds, k).select("seed_id", "document_uuid", F.lit(0).alias("source"), F.col("rank").alias("r"))
    # k cluster members may repeat among the neighbours, so 2k neighbours always suffice
    near = vector_topk(seeds.select(F.col("document_uuid").alias("qid"), F.col("embedding").alias("qvec")),
                       docs.select(F.col("document_uuid").alias("iid"), F.col("embedding").alias("ivec")), 2 * k, exclude_self=True)
    nv = near.select(F.col("qid").alias("seed_id"), F.col("iid").alias("document_uuid"), F.lit(1).alias("source"), F.col("rank").alias("r"))
    one = cl.unionByName(nv).groupBy("seed_id", "document_uuid").agg(F.min(F.struct("source", "r")).alias("m")).select("seed_id", "document_uuid", "m.*")
    return top_k(one, ["seed_id"], [F.asc("source"), F.asc("r")], k, rank="rank").select("seed_id", "document_uuid", "source", "rank")


def related_questions(results: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """Questions of the result documents without the asked text."""
    norm = X.normalize_query
    j = results.select("query_id", "query", "document_uuid", F.col("rank").alias("result_rank")).join(
        questions.select("document_uuid", "question_id", "question"), "document_uuid")
    j = j.where(norm(F.col("question")) != norm(F.col("query")))
    return top_k(j, ["query_id"], [F.asc("result_rank"), F.asc("question_id")], k, rank="rank").select("query_id", "question_id", "rank")


def answer_set(clicks: DataFrame, docs: DataFrame, k_subject: int = 20, k_cluster: int = 5) -> DataFrame:
    """Answer document, same subject, then same cluster; each document once, by its first source."""
    seeds = clicks.join(docs, "document_uuid")
    uniq = seeds.dropDuplicates(["document_uuid"])
    own = clicks.select(F.col("document_uuid").alias("seed_id"), "document_uuid", F.lit(0).alias("source"), F.lit(0).alias("r")).distinct()
    sub = same_group(docs, uniq, "primary_subject_name", k_subject).select("seed_id", "document_uuid", F.lit(1).alias("source"), F.col("rank").alias("r"))
    cl = same_group(docs, uniq, "cluster_uuid", k_cluster).select("seed_id", "document_uuid", F.lit(2).alias("source"), F.col("rank").alias("r"))
    one = own.unionByName(sub).unionByName(cl).groupBy("seed_id", "document_uuid").agg(F.min(F.struct("source", "r")).alias("m"))
    return one.select("seed_id", "document_uuid", "m.source", "m.r")


#: Fields of the quick keyword look-up.
QUICK_WEIGHTS = {"document_title": 2, "key_facts": 1}


def quick_search(queries: DataFrame, docs: DataFrame, k: int, index: IX.KeywordIndex | None = None) -> DataFrame:
    """Nearest vectors where the query has one, keywords of title and facts otherwise; ``index`` was built with ``QUICK_WEIGHTS``."""
    # queries of a session share its vector, which is searched once
    vec = queries.where(F.col("query_embedding").isNotNull()).select("query_id", "query_embedding", F.md5(F.to_json(F.struct("query_embedding"))).alias("vkey"))
    near = vector_topk(vec.dropDuplicates(["vkey"]).select(F.col("vkey").alias("qid"), F.col("query_embedding").alias("qvec")),
                       docs.select(F.col("document_uuid").alias("iid"), F.col("embedding").alias("ivec")), k)
    near = vec.select("query_id", F.col("vkey").alias("qid")).join(near.drop("rank"), "qid")
    a = top_k(near, ["query_id"], [F.asc("distance"), F.asc("iid")], k, rank="rank").select(
        "query_id", F.col("iid").alias("document_uuid"), F.lit("vector").alias("how"), "rank")
    index = IX.build(docs, QUICK_WEIGHTS, bits=()) if index is None else index
    b = keyword_candidates(queries.where(F.col("query_embedding").isNull()), docs, k, index=index).select(
        "query_id", "document_uuid", F.lit("keyword").alias("how"), F.col("candidate_rank").alias("rank"))
    return a.unionByName(b)


def attach_embeddings(df: DataFrame, text: str, vectors: DataFrame, embed=None, width: int = 384) -> DataFrame:
    """Vector of each text by its hash; texts without one go through ``embed``.

    vectors: text_hash, embedding. ``embed`` maps an iterator of
    (text_hash, text) frames to (text_hash, embedding) frames.
    """
    d = df.withColumn("text_hash", X.store_hash(F.col(text)))
    if embed is not None:
        new = d.select("text_hash", F.col(text).alias("text")).dropDuplicates(["text_hash"]).join(vectors, "text_hash", "left_anti")
        vectors = vectors.select("text_hash", "embedding").unionByName(new.mapInPandas(embed, "text_hash string, embedding array<float>"))
    return d.join(vectors.select("text_hash", "embedding"), "text_hash", "left")


def map_locations(results: DataFrame, key: str = "query_id") -> DataFrame:
    """Results with valid coordinates, the first of each query as card, with map addresses."""
    at = F.concat_ws(",", F.format_string("%.6f", "lat"), F.format_string("%.6f", "lng"))
    d = results.where(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180)).withColumns({
        "map_url": F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), at),
        "directions_url": F.concat(F.lit("https://www.google.com/maps/dir/?api=1&destination="), at)})
    first = d.groupBy(key).agg(F.min("rank").alias("_first"))
    return d.join(first, key).withColumn("is_card", F.col("rank") == F.col("_first")).drop("_first")
