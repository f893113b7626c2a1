"""Search of many token sets, slice by slice of the documents.

A slice holds the postings of its documents for all tokens asked for, and
every set. Sets whose tokens the slice does not all hold are left out; of the
others the token that is rarest in the slice gives the documents, and the
rest are looked up in the sorted postings, for all sets at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Postings of a slice, about; fewer where all cores have a slice, but not under LEAST.
SLICE, LEAST = 1 << 21, 1 << 17
#: Postings that a task packs at once, rows that are looked up at once, and rows of a batch that is returned.
PACK, AT_ONCE, BATCH = 1 << 20, 1 << 20, 1 << 16


def search(blocks: DataFrame, sets: DataFrame, lists: DataFrame | None, moved: int) -> DataFrame:
    """(token_key, document_uuid, authority, text_match, fields): as ``index.all_hits``.

    blocks: form, weight, entries (authority, document_uuid, fields). sets:
    token_key, ids of its tokens, rarest first. lists (id, ids of its forms)
    where several forms stand for a token; without, the id of a token is that
    of its form. ``moved`` is the number of postings, those of a form counted
    for each token it stands for. Postings and sets travel packed, a row for
    many of them.
    """
    spark = blocks.sparkSession
    n = max(min(2 * spark.sparkContext.defaultParallelism, -(-moved // LEAST)), -(-moved // SLICE), 1)
    # numbers that hashing deals out evenly, one for each partition: n rows come to the driver
    dealt = spark.range(32 * n).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(n))).agg(F.min("id").alias("id")).collect()
    parts, several = [r.id for r in dealt], lists is not None
    kind = blocks.schema["entries"].dataType.elementType["authority"].dataType.simpleString()
    rows = blocks.select("form", "weight", "entries").mapInArrow(lambda batches: _packed_postings(batches, parts), "part int, data binary")
    for each in (sets.select("token_key", "ids"), *([lists.select("id", "ids")] if several else [])):
        packed = each.mapInArrow(_packed, "data binary")
        rows = rows.unionByName(packed.select(F.explode(F.array(*map(F.lit, parts))).alias("part"), "data"))
    return rows.repartition(n, "part").select("data").mapInArrow(
        lambda batches: _hits(batches, several), f"token_key string, document_uuid string, authority {kind}, text_match bigint, fields array<int>")


def _bytes(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([_bytes(b)], pa.binary())], names=["data"])


def _packed_postings(batches: Iterator[pa.RecordBatch], parts: list[int]) -> Iterator[pa.RecordBatch]:
    """A row for each slice that a task's postings go to; a document's postings go to one slice."""
    held, many = [], 0

    def packed() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        named = t.column("document_uuid").chunk(0).dictionary_encode()
        to = (pd.util.hash_array(named.dictionary.to_numpy(zero_copy_only=False).astype(object)) % np.uint64(len(parts))).astype(np.int64)[np.asarray(named.indices)]
        order = np.argsort(to, kind="stable")
        b = t.take(pa.array(order)).combine_chunks().to_batches()[0]
        edges = np.searchsorted(to[order], np.arange(len(parts) + 1))
        some = [k for k in range(len(parts)) if edges[k] < edges[k + 1]]
        data = [_bytes(b.slice(edges[k], edges[k + 1] - edges[k])) for k in some]
        return pa.RecordBatch.from_arrays([pa.array([parts[k] for k in some], pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

    for b in batches:
        entries = b.column("entries")
        size = np.asarray(entries.value_lengths())
        e = entries.flatten()
        own = dict(zip([f.name for f in e.type], e.flatten()))
        held.append(pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column(c)), size)) for c in ("form", "weight")] + [own[c] for c in _ENTRY], names=["form", "weight", *_ENTRY]))
        many += len(e)
        if many >= PACK:
            yield packed()
            held, many = [], 0
    if many:
        yield packed()


_ENTRY = ("fields", "document_uuid", "authority")


def _hits(batches: Iterator[pa.RecordBatch], several: bool) -> Iterator[pa.RecordBatch]:
    """The hits of a slice, whose postings, sets and lists come packed in any order."""
    post, sets, lists = [], [], []
    for b in batches:
        for data in b.column("data"):
            for r in pa.ipc.open_stream(data.as_buffer()):
                (sets if "token_key" in r.schema.names else lists if "id" in r.schema.names else post).append(r)
    if post and sets and (lists or not several):
        yield from _search(post, sets, lists)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(lists.flatten()).astype(np.int64), np.asarray(lists.value_lengths()).astype(np.int64)


def _starts(key: np.ndarray) -> np.ndarray:
    """Where the runs of a sorted array begin."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def _search(post: list[pa.RecordBatch], sets: list[pa.RecordBatch], lists: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hits of all sets among the postings; a set may come several times."""
    several = bool(lists)
    p, s = (pa.Table.from_batches(x).combine_chunks() for x in (post, sets))
    post.clear(), sets.clear()
    one = lambda t, c: t.column(c).chunk(0)

    named = one(p, "document_uuid").dictionary_encode()
    names, doc = named.dictionary, np.asarray(named.indices).astype(np.int64)
    n_docs = len(names)
    forms, form = np.unique(np.asarray(one(p, "form")), return_inverse=True)
    key = form * n_docs + doc
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = _starts(key)
    times = np.diff(np.r_[first, len(key)])  # an id that several documents share has an entry for each in every posting
    at, key = order[first], key[first]
    weight, fields = np.asarray(one(p, "weight"))[at].astype(np.int64), np.asarray(one(p, "fields"))[at].astype(np.int32)
    own = np.unique(key % n_docs, return_index=True)[1]
    entry, entries, authority = first[own], times[own], one(p, "authority")
    shared = bool((entries > 1).any())

    if several:  # a posting for each token and document: the heaviest form, the fields of all
        rows = pa.Table.from_batches(lists).combine_chunks()
        ids, own_list = np.unique(np.asarray(one(rows, "id")).astype(np.int64), return_index=True)
        flat, sizes = _flat(one(rows, "ids").take(pa.array(own_list)))
        token = np.repeat(np.arange(len(ids)), sizes)
        f = np.minimum(np.searchsorted(forms, flat), len(forms) - 1)
        token, f = token[forms[f] == flat], f[forms[f] == flat]
        bounds = np.searchsorted(key, np.arange(len(forms) + 1) * n_docs)
        counts = bounds[f + 1] - bounds[f]
        take = _ranges(bounds[f], counts)
        k = np.repeat(token, counts) * n_docs + key[take] % n_docs
        by = np.argsort(k, kind="stable")
        k, take = k[by], take[by]
        first = _starts(k)
        if not len(first):
            return
        key, weight, fields = k[first], np.maximum.reduceat(weight[take], first), np.bitwise_or.reduceat(fields[take], first)
    else:
        ids = forms

    bounds = np.searchsorted(key, np.arange(len(ids) + 1) * n_docs)
    count = np.diff(bounds)
    keys = one(s, "token_key").dictionary_encode()
    once = np.unique(np.asarray(keys.indices), return_index=True)[1]
    keys = keys.dictionary
    flat, size = _flat(one(s, "ids").take(pa.array(once)))
    # the dictionary numbers the keys by their first place, and so does ``once``
    token = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
    held = np.where(ids[token] == flat, count[token], 0)
    start = np.cumsum(size) - size
    alive = np.flatnonzero(np.minimum.reduceat(held, start) > 0)
    pick = _ranges(start[alive], size[alive])
    size = size[alive]
    of = np.repeat(np.arange(len(alive)), size)
    start = np.cumsum(size) - size
    nth = np.arange(len(pick)) - np.repeat(start, size)  # 1 is the second rarest of the collection
    by = np.lexsort((held[pick], of))
    token, nth = token[pick][by], nth[by]
    reads = count[token[start]]
    second = np.zeros(len(alive), np.int64)
    second[of[nth == 1]] = np.flatnonzero(nth == 1) - start[of[nth == 1]]
    keys = keys.take(pa.array(alive))

    def rows_of(r: np.ndarray, d: np.ndarray, total: np.ndarray, met: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        bits = np.stack([fields[m] for m in met], axis=1)
        place, width = entry[d], np.full(len(r), len(met), np.int64)
        values = bits.ravel()
        if shared:
            many = entries[d]
            if len(met) == 1:  # a row for each document that shares the id; where forms were joined, for each of their authorities
                take, place = np.repeat(np.arange(len(r)), many), _ranges(place, many)
                if several:
                    code = np.asarray(authority.take(pa.array(order[place])).dictionary_encode(null_encoding="encode").indices).astype(np.int64)
                    unlike = np.unique(take * (int(code.max()) + 1) + code, return_index=True)[1]
                    take, place = take[unlike], place[unlike]
                r, d, total, width, values = r[take], d[take], total[take], width[take], values[take]
            elif not several:  # the second rarest token counts once for each of them
                again = np.stack(met, axis=1)[np.arange(len(r)), second[r]]
                total = total + (many - 1) * weight[again]
                extra = np.repeat(fields[again], many - 1)
                values = np.insert(values, np.repeat(np.cumsum(width), many - 1), extra)
                width = width + many - 1
        ends = np.r_[0, np.cumsum(width)]
        for a in range(0, len(r), BATCH):
            z = min(a + BATCH, len(r))
            yield pa.RecordBatch.from_arrays([
                keys.take(pa.array(r[a:z])), names.take(pa.array(d[a:z])), authority.take(pa.array(order[place[a:z]])), pa.array(total[a:z]),
                pa.ListArray.from_arrays(pa.array((ends[a:z + 1] - ends[a]).astype(np.int32)), pa.array(values[ends[a]:ends[z]].astype(np.int32)))],
                names=["token_key", "document_uuid", "authority", "text_match", "fields"])

    edges = np.searchsorted(np.cumsum(reads), np.arange(0, int(reads.sum()) + AT_ONCE, AT_ONCE)) if len(reads) else np.zeros(0, np.int64)
    edges = np.unique(np.r_[0, edges, len(alive)])
    for a, z in zip(edges[:-1], edges[1:]):
        r = np.repeat(np.arange(a, z), reads[a:z])
        met = [_ranges(bounds[token[start[a:z]]], reads[a:z])]
        d, total = key[met[0]] % n_docs, weight[met[0]]
        while len(r):
            done = size[r] == len(met)
            if done.any():
                yield from rows_of(r[done], d[done], total[done], [m[done] for m in met])
                r, d, total, met = r[~done], d[~done], total[~done], [m[~done] for m in met]
            if len(r):
                k = token[start[r] + len(met)] * n_docs + d
                at = np.minimum(np.searchsorted(key, k), len(key) - 1)
                ok = key[at] == k
                at, r, d, met = at[ok], r[ok], d[ok], [m[ok] for m in met]
                total = total[ok] + weight[at]
                met.append(at)
