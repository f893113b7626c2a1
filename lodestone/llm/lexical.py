"""Ranked lexical search: documents of an item grouped by the terms they hold.

Every text is read once for the terms that items ask for. For each item, the
presence bitmaps of its terms over a block of documents are turned into one
mask a document; documents of equal masks form a group. A mask can't score
more than the sum of its terms' best contributions in the block, so groups are
evaluated by descending bound until the bound is below the k-th best score
known to the task. What a task has found carries over to its next blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import discard, stored
from lodestone.operators.windows import top_k

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Items and different terms that one pass over the documents serves; more items make more passes.
PASS_ITEMS, PASS_TERMS = 1024, 1 << 17
#: Documents whose bitmaps are held at once.
BLOCK = 2048
#: Documents evaluated between two looks at the bound.
STEP = 64
#: Texts beyond this are matched term by term, not as one list.
LONG = 1 << 20


def terms(text: Column) -> Column:
    """Terms of a text in order, A-Z in lower case; of null none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


# ---- reading the documents ------------------------------------------------------------

def _reader(vocabulary: dict[str, int]):
    found = re.compile(TERM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, size, which, often = [], [], [], []
            for text in batch.column(1):
                low = (text.as_py() or "").encode().lower().decode()
                have = Counter(found.findall(low) if len(low) < LONG else (m.group() for m in found.finditer(low)))
                hit = [(vocabulary[t], c) for t, c in have.items() if t in vocabulary]
                n.append(have.total())
                size.append(len(hit))
                which.extend(h[0] for h in hit)
                often.extend(h[1] for h in hit)
            ends = pa.array(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(which, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(often, pa.int64()))], ["doc_id", "n", "term", "tf"])

    return run


# ---- one block of documents --------------------------------------------------------------

class Best:
    """The k best (score, id) of an item so far; a null id comes last among equals."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score = self.null = self.id = np.zeros(0, np.int64)

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        ok = score >= self.least
        if not ok.any():
            return
        score, null, ids = (np.concatenate(x) for x in ((self.score, score[ok]), (self.null, null[ok]), (self.id, ids[ok])))
        keep = np.lexsort((ids, null, -score))[:self.k]
        self.score, self.null, self.id = score[keep], null[keep], ids[keep]
        if len(keep) == self.k:
            self.least = max(int(self.score[-1]), 1)


class Block:
    """Postings of some documents: by document for evaluation, by term as presence bitmaps and best contributions."""

    def __init__(self, batch: pa.RecordBatch, weight: np.ndarray):
        ids, m, term, tf = batch.columns
        self.n = batch.num_rows
        self.null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.int64)
        self.ids = ids.fill_null(0).to_numpy()
        self.size = term.value_lengths().to_numpy().astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.term, tf = term.flatten().to_numpy(), tf.flatten().to_numpy()
        self.part = weight[self.term] * ((1000000000 * tf) // (1000 * tf + 20 * np.repeat(m.to_numpy(), self.size)))
        present, row = np.unique(self.term, return_inverse=True)
        bits = np.zeros((len(present) + 1, self.n), bool)
        bits[row, np.repeat(np.arange(self.n), self.size)] = True
        self.bits = np.packbits(bits, axis=1)
        self.row = np.full(len(weight), len(present))
        self.row[present] = np.arange(len(present))
        self.most = np.zeros(len(present) + 1, np.int64)
        np.maximum.at(self.most, row, self.part)

    def search(self, item: np.ndarray, asked: np.ndarray, best: Best) -> int:
        """Evaluates what the item may find here; returns the number of documents looked at. ``asked`` is false throughout."""
        rows = self.row[item]
        rows = rows[self.most[rows] > 0]
        most = self.most[rows]
        if most.sum() < best.least:
            return 0
        held = np.unpackbits(self.bits[rows], axis=1, count=self.n)
        by_doc = np.packbits(held, axis=0)
        words = -(-len(by_doc) // 8)
        mask = np.zeros((self.n, words * 8), np.uint8)
        mask[:, :len(by_doc)] = by_doc.T
        mask = mask.view(np.uint64)[:, 0] if words == 1 else mask.view(f"V{words * 8}")[:, 0]
        masks, first, group = np.unique(mask, return_index=True, return_inverse=True)
        bound = most @ held[:, first].astype(np.int64)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] >= best.least]
        members = np.argsort(group, kind="stable")
        count = np.bincount(group, minlength=len(masks))
        start = np.cumsum(count) - count
        asked[item] = True
        seen = at = 0
        while at < len(order) and bound[order[at]] >= best.least:
            upto = at + 1 + int(np.searchsorted(np.cumsum(count[order[at:]]), STEP))
            docs = np.concatenate([members[start[g]:start[g] + count[g]] for g in order[at:upto]])
            size = self.size[docs]
            begin = np.cumsum(size) - size
            at_post = np.repeat(self.begin[docs] - begin, size) + np.arange(size.sum())
            score = np.add.reduceat(self.part[at_post] * asked[self.term[at_post]], begin)
            best.add(score, self.null[docs], self.ids[docs])
            seen, at = seen + len(docs), upto
        asked[item] = False
        return seen


def _searcher(items: list[np.ndarray], weight: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, asked = [Best(k) for _ in items], np.zeros(len(weight), bool)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = Block(batch.slice(at, BLOCK), weight)
                for item, own in zip(items, best):
                    block.search(item, asked, own)
        got = [(np.full(len(b.id), i, np.int32), b) for i, b in enumerate(best) if len(b.id)]
        for i, b in got:
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(b.id, pa.int64(), mask=b.null.astype(bool)), pa.array(b.score)], ["item", "doc_id", "score"])

    return run


# ---- the operator ------------------------------------------------------------------------

def _pass(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Ranks the documents for a block of items of bounded size."""
    spark = docs.sparkSession
    asked = items.collect()
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for r in asked for t in r.terms))}
    of_item = [np.array(sorted(vocabulary[t] for t in set(r.terms)), np.int64) for r in asked]
    index = stored(docs.mapInArrow(_reader(vocabulary), "doc_id long, n long, term array<int>, tf array<long>").where("n > 0"), "lexical-index")
    number, length = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # at most the block's terms
        df[r["term"]] = r["count"]
    weight = np.floor(1000 * np.log((2 * number + 2) / (2 * df + 1))).astype(np.int64)
    scored = index.select("doc_id", F.expr(f"50 + (50 * n * {number}L) div {max(length, 1)}L").alias("m"), "term", "tf").where(F.size("term") > 0)
    hits = scored.mapInArrow(_searcher(of_item, weight, k), "item int, doc_id long, score long")
    ranked = top_k(hits, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, "rank")
    ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(asked)], "item int, item_id long")
    return ranked.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of every item, equal scores by id, a null id last.

    Every row of ``docs`` is a document and every row of ``items`` an item of
    its own, also with a null or repeated id. Null and empty texts have no
    terms: as documents they count nowhere, as items they find nothing. Counts
    of documents and terms cover the whole collection.

    ``items`` is a stated set of queries. It is served in blocks of about
    ``PASS_ITEMS`` items or ``PASS_TERMS`` terms, each with a pass over the
    documents; one block's terms and weights go to the tasks. A task returns at
    most k rows an item, however many documents it has read.
    """
    asked = stored(items.select(F.col(item_col).cast("long").alias("item_id"), F.array_distinct(terms(F.col(item_text_col))).alias("terms")).where(F.size("terms") > 0), "lexical-items")
    number, total = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    passes = max(-(-number // PASS_ITEMS), -(-total // PASS_TERMS), 1)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    block = F.pmod(F.xxhash64("item_id", "terms"), F.lit(passes))
    return reduce(DataFrame.unionByName, [_pass(texts, asked.where(block == b), k) for b in range(passes)])


SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
m AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM d, a),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), a),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
