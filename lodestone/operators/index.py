"""Inverted index in blocks of equal weight, and the search of token sets in it.

Three tables describe a collection: ``blocks`` holds the postings of a token,
cut into blocks of bounded size whose entries have one weight, ``heads`` one
narrow row for each block, and ``probe`` every posting by itself, to ask
whether a document has a token. A search meets heads first, so blocks that
can't matter are never read; a frequent token is spread over as many rows as
it has blocks and never lies in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import slices as SL
from lodestone.operators.windows import spread, top_k
from lodestone.rules import scoring as R
from lodestone.session import materialize

#: Postings of a block, about.
BLOCK = 1024
#: How many times the postings of the round before a further round of ``best_hits`` takes.
MORE = 8
#: Rows that the rarest tokens of all sets may read for the sets to be joined with the index; with more, ``all_hits`` goes through slices of the documents.
JOINED = 1 << 20
#: What the kept tables are bucketed by.
BLOCK_KEY, PROBE_KEY = ("block", "token", "weight"), ("token", "document_uuid")


@dataclass(frozen=True)
class KeywordIndex:
    """heads: token, weight, block, n, least, most (authority); blocks: block, token, weight, entries; probe: token, document_uuid, weight, fields.

    Searches join heads on the token, blocks and probe on the columns they are
    kept by, no more and no fewer, so that none of them is shuffled.
    """

    heads: DataFrame
    blocks: DataFrame
    probe: DataFrame

    def terms(self) -> DataFrame:
        """(token, df, top): documents that hold a token, and its largest weight."""
        return self.heads.groupBy("token").agg(F.sum("n").alias("df"), F.max("weight").alias("top"))


#: The bit of a field in ``fields``: those that retrieval weighs, then those that only scoring looks at.
FIELD_BITS = {f: 1 << i for i, f in enumerate(dict.fromkeys([*R.SEARCH_FIELD_WEIGHTS, *R.FIELD_WEIGHTS]))}


def postings(docs: DataFrame, weights: dict[str, int] | None = None, bits: Iterable[str] | None = None) -> DataFrame:
    """(token, document_uuid, weight, fields, authority): summed weight of the fields holding the token, and a bit for each field that does.

    A token that only fields without a weight hold has no posting; those fields
    of a collection still set their bits, or only those named in ``bits``, where the others are not asked for. ``authority``, where the collection
    has one, is the largest of the rows that hold the token under this id.
    """
    weights = weights or R.SEARCH_FIELD_WEIGHTS
    kinds = dict(docs.dtypes)

    def entry(f: str) -> Column:
        text = F.array_join(f, " ") if kinds[f].startswith("array") else F.col(f)
        return F.transform(X.match_tokens(text), lambda t: F.struct(t.alias("token"), F.lit(weights.get(f, 0)).alias("w"), F.lit(FIELD_BITS.get(f, 0)).alias("b")))

    read = [f for f in dict.fromkeys([*weights, *(FIELD_BITS if bits is None else bits)]) if f in kinds]
    own = ["authority_rank_score"] if "authority_rank_score" in kinds else []
    return (docs.select("document_uuid", *own, F.explode(F.concat(*[entry(f) for f in read])).alias("e"))
            .groupBy("e.token", "document_uuid").agg(F.sum("e.w").alias("weight"), F.bit_or("e.b").alias("fields"), *[F.max(c).alias("authority") for c in own])
            .where(F.col("weight") > 0))


def in_blocks(post: DataFrame, docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(block, token, weight, n, least, most, entries): postings of a token and weight, dealt by document into blocks of about ``size``.

    Blocks need no order among the postings of a token, so none is sorted. Only
    the narrow counts of tokens with more than ``size`` postings and the ids that
    several rows of ``docs`` share meet the postings, which move once, to their blocks.
    An id that several rows share has an entry for each of them.
    """
    rows = docs.where(F.col("document_uuid").isNotNull()).groupBy("document_uuid").agg(
        F.count(F.lit(1)).alias("_n"), F.collect_list(F.struct(F.col("authority_rank_score").alias("authority"))).alias("_each"))
    shared = materialize(rows.where(F.col("_n") > 1).select("document_uuid", "_each"), "index-shared-ids")
    many = materialize(post.groupBy("token", "weight").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_cuts")).where(F.col("_cuts") > 1), "index-frequent")
    d = post.where(F.col("document_uuid").isNotNull())
    if not shared.isEmpty():
        d = d.join(shared, "document_uuid", "left").withColumn("_a", F.explode(F.coalesce("_each", F.array(F.struct("authority")))))
        d = d.withColumn("authority", F.col("_a.authority")).drop("_each", "_a")
    d = d.join(many, ["token", "weight"], "left").withColumn("_cut", F.coalesce(F.pmod(F.xxhash64("document_uuid"), F.col("_cuts")), F.lit(0).cast("bigint")))
    d = d.withColumn("block", F.xxhash64("token", "weight", "_cut"))
    # most postings are alone in their map task, so lists made before the shuffle would only add their heads to it
    d = spread(d.select(*BLOCK_KEY, "authority", "document_uuid", "fields"), *BLOCK_KEY)
    return (d.groupBy(*BLOCK_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("authority").alias("least"), F.max("authority").alias("most"),
        F.collect_list(F.struct("authority", "document_uuid", "fields")).alias("entries"))
        .select("block", "token", "weight", "n", "least", "most", "entries"))


#: How a table of the index is kept: (name, its rows, the columns it is bucketed by) -> the kept table.
Keeper = Callable[[str, Callable[[], DataFrame], tuple[str, ...]], DataFrame]


def _for_this_job(name: str, make: Callable[[], DataFrame], by: tuple[str, ...]) -> DataFrame:
    return materialize(make(), f"index-{name}")


def build(docs: DataFrame, weights: dict[str, int] | None = None, keep: Keeper = _for_this_job, post: DataFrame | None = None,
          bits: Iterable[str] | None = None) -> KeywordIndex:
    """The index of a collection. ``keep`` decides where its tables live; without it they serve the job at hand."""
    def probe() -> DataFrame:
        p = postings(docs, weights, bits) if post is None else post
        if "authority" not in p.columns:
            own = docs.where(F.col("document_uuid").isNotNull()).groupBy("document_uuid").agg(F.max("authority_rank_score").alias("authority"))
            p = p.join(own, "document_uuid")
        return p.select(*PROBE_KEY, "weight", "fields", "authority")

    kept = keep("probe", probe, PROBE_KEY)
    blocks = keep("blocks", lambda: in_blocks(kept, docs), BLOCK_KEY)
    heads = keep("heads", lambda: blocks.select("token", "weight", "block", "n", "least", "most"), ("token",))
    return KeywordIndex(heads, blocks.select("block", "token", "weight", "entries"), kept.drop("authority"))


# ---- search --------------------------------------------------------------------------

def _asked(sets: DataFrame, index: KeywordIndex, variants: DataFrame | None) -> DataFrame:
    """(token_key, need, bound, lead, rest, rows): sets whose tokens are all known.

    ``lead`` lists the index tokens that may stand for the rarest token, ``rest``
    one such list for each other token, rarest first; ``bound`` is the most that
    the others can add to a document's weight, ``rows`` what the rarest reads.
    """
    toks = _tokens(sets)
    terms = index.terms().withColumnRenamed("token", "alt")
    if variants is None:
        known = toks.withColumn("alt", F.col("token")).join(terms, "alt").select("token_key", "token", "df", "top", F.array("alt").alias("alts"))
    else:
        own = variants.select("token", "alt").unionByName(toks.select("token", F.col("token").alias("alt"))).distinct()
        known = toks.join(own.join(terms, "alt").groupBy("token").agg(
            F.sum("df").alias("df"), F.max("top").alias("top"), F.sort_array(F.collect_list("alt")).alias("alts")), "token")
    each = F.sort_array(F.collect_list(F.struct("df", "token", "top", "alts")))
    lists = known.groupBy("token_key").agg(each.alias("t")).where(F.size("t") == F.size(F.split("token_key", " ")))
    rest = F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(1)))
    return lists.select("token_key", F.size("t").alias("need"), F.aggregate(rest, F.lit(0).cast("bigint"), lambda a, x: a + x["top"]).alias("bound"),
                        F.col("t")[0]["alts"].alias("lead"), F.transform(rest, lambda x: x["alts"]).alias("rest"), F.col("t")[0]["df"].alias("rows"))


def _tokens(sets: DataFrame) -> DataFrame:
    """(token_key, token) of every set that has a token."""
    s = sets.select("token_key").where(F.col("token_key") != "").distinct()
    return s.select("token_key", F.explode(F.split("token_key", " ")).alias("token"))


def _requests(asked: DataFrame, index: KeywordIndex) -> DataFrame:
    """Blocks that may hold documents of a set: those of its rarest token; ``second`` lists the forms of the next one."""
    return asked.select("token_key", "need", "bound", F.get("rest", F.lit(0)).alias("second"), F.explode("lead").alias("token")).join(index.heads, "token")


def _read(requests: DataFrame, index: KeywordIndex, several: bool) -> DataFrame:
    """(token_key, need, second, document_uuid, authority, text_match, fields): the documents of requested blocks, weighed by the rarest token."""
    key = list(BLOCK_KEY)
    d = (requests.select("token_key", "need", "second", *key).join(index.blocks, key)
         .select("token_key", "need", "second", F.col("weight").alias("text_match"), F.explode("entries").alias("e"))
         .select("token_key", "need", "second", "text_match", "e.document_uuid", "e.authority", F.array("e.fields").alias("fields")))
    if several:  # a document may hold several forms of the token
        d = d.groupBy("token_key", "document_uuid", "authority").agg(F.max("text_match").alias("text_match"), F.array(F.bit_or(F.col("fields")[0])).alias("fields"),
                                                                     *[F.first(c).alias(c) for c in ("need", "second")])
    return d


def _probed(found: DataFrame, lists: Column, index: KeywordIndex, several: bool, one: bool = False) -> DataFrame:
    """Rows of ``found`` whose document holds a token of every list (each row has ``one``), with the weights added.

    The lists of a row are numbered, each number must be met; of several forms
    of a token the heaviest counts.
    """
    keys = ["token_key", "document_uuid"]
    rows = found.select(*keys, "need", "authority", "text_match", "fields", F.posexplode(lists).alias("_i", "_alts"))
    rows = rows.withColumn("token", F.explode("_alts") if several else F.col("_alts")[0]).drop("_alts")
    met = rows.join(index.probe.select(*PROBE_KEY, "weight", F.col("fields").alias("_f")), list(PROBE_KEY))
    carried = [F.first(c).alias(c) for c in ("need", "authority", "text_match", "fields")]
    if several:
        met = met.groupBy(*keys, "_i").agg(F.max("weight").alias("weight"), F.bit_or("_f").alias("_f"), *carried)
    # with one list of one form the token follows from the set, and the rows already lie by token and document
    by = [*keys, "token"] if one and not several else keys
    all_of = met.groupBy(*by).agg(F.sum("weight").alias("_w"), F.collect_list("_f").alias("_f"), F.count(F.lit(1)).alias("_got"), *carried)
    return all_of.withColumns({"text_match": F.col("text_match") + F.col("_w"), "fields": F.concat("fields", "_f")}).select(
        *keys, "_got", "need", "authority", "text_match", "fields")


_HIT = ["token_key", "document_uuid", "authority", "text_match", "fields"]


def _complete(found: DataFrame, asked: DataFrame, index: KeywordIndex, several: bool) -> DataFrame:
    """Documents that hold the other tokens too: the second rarest is asked first, the others only where it is held.

    Rows carry the forms of the second token alone; the lists of the others,
    far longer than a row, meet the documents that are left.
    """
    found = materialize(found, "index-found")
    second = _probed(found.where(F.col("need") > 1), F.array("second"), index, several, one=True).drop("_got")
    second = materialize(second, "index-second")
    more = second.where(F.col("need") > 2).join(asked.select("token_key", F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(1))).alias("others")), "token_key")
    others = _probed(more, F.col("others"), index, several).where(F.col("_got") == F.col("need") - 2)
    return (found.where(F.col("need") == 1).select(_HIT).unionByName(second.where(F.col("need") == 2).select(_HIT)).unionByName(others.select(_HIT)))


def all_hits(sets: DataFrame, index: KeywordIndex, variants: DataFrame | None = None) -> DataFrame:
    """(token_key, document_uuid, authority, text_match, fields): every document that holds all tokens of a set.

    ``fields`` has, for each token in no order, the bits of the fields that hold it.
    ``sets`` has token_key, the sorted tokens joined by a space. ``variants``
    (token, alt) lets an index token stand for a token of the set.
    """
    several = variants is not None
    if not several:
        asked = materialize(_asked(sets, index, None), "index-asked")
        wanted = asked.select("token_key", F.concat(F.slice("lead", 1, 1), F.transform("rest", lambda x: x[0])).alias("tokens"), "rows")
        forms = None
    else:  # the forms of a token are listed once, not for every set that has it
        toks = _tokens(sets)
        terms = index.terms().select(F.col("token").alias("alt"), "df")
        every = variants.select("token", "alt").unionByName(toks.select("token", F.col("token").alias("alt")))
        forms = materialize(every.distinct().join(terms, "alt").join(toks.select("token").distinct(), "token", "left_semi"), "index-forms")
        each = F.sort_array(F.collect_list(F.struct("df", "token")))
        lists = toks.join(forms.groupBy("token").agg(F.sum("df").alias("df")), "token").groupBy("token_key").agg(each.alias("t"))
        lists = lists.where(F.size("t") == F.size(F.split("token_key", " ")))
        wanted = materialize(lists.select("token_key", F.col("t.token").alias("tokens"), F.col("t")[0]["df"].alias("rows")), "index-wanted")
    if (wanted.agg(F.sum("rows")).first()[0] or 0) > JOINED:
        return _sliced_hits(wanted, forms, index)
    asked = materialize(_asked(sets, index, variants), "index-asked") if several else asked
    return _complete(_read(_requests(asked, index), index, several), asked, index, several)


def _sliced_hits(wanted: DataFrame, forms: DataFrame | None, index: KeywordIndex) -> DataFrame:
    """``all_hits`` of many sets: the postings of all their tokens move once, to slices of the documents, and every set is met in every slice.

    What moves grows with the postings and with sets times slices, not with
    what the sets read. ``wanted`` has the tokens of each set, rarest first;
    ``forms`` (token, alt, df) the index tokens that may stand for a token,
    itself alone without.
    """
    wanted = wanted.select("token_key", F.posexplode("tokens").alias("pos", "token"))
    named = lambda df, label, out: materialize(df.distinct().withColumn(out, F.monotonically_increasing_id()), label)
    tokens = named(wanted.select("token"), "index-tokens", "id")
    sets = wanted.join(tokens, "token").groupBy("token_key").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("t")).select(
        "token_key", F.col("t.id").alias("ids"))
    lists = None
    if forms is None:
        read = tokens.select("token", F.col("id").alias("form"))
    else:
        read = named(forms.select(F.col("alt").alias("token")), "index-alts", "form")
        lists = forms.join(tokens, "token").join(read.withColumnRenamed("token", "alt"), "alt").groupBy("id").agg(F.collect_list("form").alias("ids"))
    heads = read.join(index.heads, "token").select("form", *BLOCK_KEY, "n")
    # a number comes to the driver: postings that move, those of a form counted for each token that it stands for
    moved = heads if forms is None else heads.join(lists.select(F.explode("ids").alias("form")), "form")
    blocks = heads.drop("n").join(index.blocks, list(BLOCK_KEY)).select("form", "weight", "entries")
    return SL.search(blocks, materialize(sets, "index-sets"), lists, moved.agg(F.sum("n")).first()[0] or 0)


def best_hits(sets: DataFrame, index: KeywordIndex, k: int) -> DataFrame:
    """As ``all_hits``, the k best of each set only: by weight, authority, id.

    Blocks of a set are taken in the order of the largest weight that a
    document in them can reach: first as many as hold k postings, then a block,
    then ``MORE`` times as many, and so on; every round reads the index. Once a set has k documents, blocks whose bound lies below
    the last of them are left unread; most sets need one round.
    """
    order = [F.desc("text_match"), F.desc("authority"), F.asc("document_uuid")]
    asked = materialize(_asked(sets, index, None), "index-asked")
    req = _requests(asked, index).withColumn("bound", F.col("bound") + F.col("weight"))
    ahead = W.partitionBy("token_key").orderBy(F.desc("bound"), F.desc("most"), F.asc("block")).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(ahead), F.lit(0))  # one narrow row a block: a set's heads, not its postings
    low = F.lit(float("-inf"))
    left, best, upto = materialize(req.withColumn("before", before), "index-requests"), None, k
    while True:
        got = _complete(_read(left.where(F.col("before") < upto), index, False), asked, index, False)
        best = materialize(top_k(got if best is None else best.select(_HIT).unionByName(got), ["token_key"], order, k, rank="_rank"), "index-best")
        sure = best.where(F.col("_rank") == k).select("token_key", F.col("text_match").alias("_w"), F.col("authority").alias("_a"))
        may = F.col("_w").isNull() | (F.col("bound") > F.col("_w")) | (F.col("bound") == F.col("_w")) & (F.coalesce("most", low) >= F.coalesce("_a", low))
        left = materialize(left.where(F.col("before") >= upto).join(sure, "token_key", "left").where(may).drop("_w", "_a"), "index-left")
        if left.isEmpty():
            return best.select(_HIT)
        upto = max(upto * MORE, BLOCK)


def set_totals(sets: DataFrame, index: KeywordIndex) -> DataFrame:
    """(token_key, total): how many documents each set finds. One token's total is its count in the index; only longer sets are searched."""
    asked = _asked(sets, index, None)
    one = asked.where(F.col("need") == 1).select("token_key", F.col("lead")[0].alias("token")).join(index.terms(), "token").select("token_key", F.col("df").alias("total"))
    more = all_hits(asked.where(F.col("need") > 1).select("token_key"), index).groupBy("token_key").agg(F.count(F.lit(1)).alias("total"))
    return one.unionByName(more)
