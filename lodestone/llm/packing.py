"""Packing of tokenised documents into sequences as a cutting-stock problem.

Documents are cut into full sequences and one remainder. The remainders'
lengths, rounded up to a grid, form a histogram; column generation solves the
linear program over patterns (which lengths share a sequence), pricing new
patterns by a knapsack dynamic program. Rounded patterns, and best-fit patterns
for what rounding leaves, are then assigned to the documents by their rank
within each length class. Only the histogram (at most ``capacity / grid`` rows)
reaches the driver.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.store import stored

CAPACITY = 2048
GRID = 8
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
#: Rows that are ranked together; a length class with more is ranked in parts.
RANK_GROUP = 512


def byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Encoder of the vocabulary's ordinary tokens, and its added tokens (text to id)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    back = byte_of_char()
    ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), added


def token_ids(text: str, path: str) -> array:
    """Ids of a whole text; strings of added tokens become those tokens."""
    enc, added = _encoder(path)
    out = array("I")
    while text:
        at, name = min(((k, t) for t in added if (k := text.find(t)) >= 0), default=(len(text), None))
        out.extend(enc.encode_ordinary(text[:at]))
        if name is None:
            break
        out.append(added[name])
        text = text[at + len(name):]
    return out


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Each document's tokens, ``end_id`` last, cut every ``capacity`` tokens: doc_id, start, length, ids_crc32, doc_tokens, mix (and ids)."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "mix"] + ["ids"] * with_ids

    def run(batches):
        seen = 0
        for b in batches:
            out = [[] for _ in names]
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = token_ids(t.as_py() or "", path)
                ids.append(end_id)
                raw = memoryview(ids.tobytes())
                for s in range(0, len(ids), capacity):
                    n = min(capacity, len(ids) - s)
                    row = (i, s, n, zlib.crc32(raw[4 * s:4 * (s + n)]), len(ids), seen) + ((list(ids[s:s + n]),) if with_ids else ())
                    seen += 1
                    for col, x in zip(out, row):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:6]] + [pa.array(c, pa.list_(pa.int64())) for c in out[6:]], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(
        run, ", ".join(f"{c} {'array<long>' if c == 'ids' else 'long'}" for c in names))


def best_pattern(value: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Knapsack: the multiset of classes 1..units of the greatest total value that fits into ``units``."""
    best, take = np.zeros(units + 1), np.zeros(units + 1, dtype=np.int64)
    gain = value[1:]
    for w in range(1, units + 1):
        total = best[w - 1::-1][:w] + gain[:w]  # class c leaves w - c
        c = int(np.argmax(total))
        if total[c] > best[w - 1]:
            best[w], take[w] = total[c], c + 1
        else:
            best[w] = best[w - 1]
    out, w = np.zeros(units + 1, dtype=np.int64), units
    while w > 0:
        if take[w]:
            out[take[w]] += 1
            w -= take[w]
        else:
            w -= 1
    return float(best[units]), out


def column_generation(demand: np.ndarray, units: int, gap: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often (a real number) the linear program uses each; ``demand[c]`` items have class c."""
    classes = np.flatnonzero(demand)
    m = len(classes)
    if not m:
        return []
    patterns = []
    for c in classes:
        p = np.zeros(units + 1, dtype=np.int64)
        p[c] = units // c
        patterns.append(p)
    inverse = np.diag([1.0 / (units // c) for c in classes])
    x = inverse @ demand[classes].astype(float)
    for _ in range(50 * m + 200):
        dual = inverse.sum(axis=0)  # each pattern costs 1
        value = np.zeros(units + 1)
        value[classes] = np.maximum(dual, 0)
        worth, new = best_pattern(value, units)
        if worth <= 1 + gap:  # x.sum() / worth bounds the optimum from below
            break
        d = inverse @ new[classes].astype(float)
        up = d > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / d[up]
        r = int(np.argmin(ratio))
        x = np.maximum(0, x - ratio[r] * d)
        x[r] = ratio[r]
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
        patterns[r] = new
    return list(zip(patterns, x))


def best_fit(items: np.ndarray, units: int) -> list[np.ndarray]:
    """Best-fit decreasing: patterns that hold the given numbers of items of each class."""
    free: list[list[np.ndarray]] = [[] for _ in range(units + 1)]
    out = []
    for c in range(units, 0, -1):
        for _ in range(int(items[c])):
            w = next((w for w in range(c, units + 1) if free[w]), None)
            if w is None:
                p, w = np.zeros(units + 1, dtype=np.int64), units
                out.append(p)
            else:
                p = free[w].pop()
            p[c] += 1
            if w > c:
                free[w - c].append(p)
    return out


def whole_patterns(demand: np.ndarray, units: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole multiplicities that hold exactly the demand."""
    left, out = demand.copy(), Counter()
    for p, x in column_generation(demand, units):
        # to the nearest, or as often as the items last: what is left is bounded by the number of patterns
        used = p > 0
        k = min(int(x + 0.5), int((left[used] // p[used]).min()))
        if k > 0:
            out[tuple(p)] += k
            left -= k * p
    for p in best_fit(left, units):
        out[tuple(p)] += 1
    return [(np.array(p, dtype=np.int64), k) for p, k in out.items()]


def _segments(patterns: list[tuple[np.ndarray, int]], demand: np.ndarray):
    """The items in the order of class and rank, as stretches: first item, first sequence, items of the class in a sequence."""
    base, of_class = 0, {}
    for p, k in patterns:
        for c in np.flatnonzero(p):
            of_class.setdefault(int(c), []).append((int(k * p[c]), base, int(p[c])))
        base += k
    first, seq, each, at = [], [], [], 0
    for c in range(len(demand)):
        for n, s, a in of_class.get(c, []):
            first.append(at)
            seq.append(s)
            each.append(a)
            at += n
    return np.array(first, dtype=np.int64), np.array(seq, dtype=np.int64), np.array(each, dtype=np.int64)


def assign(lengths: DataFrame, capacity: int = CAPACITY, grid: int = GRID, rank_group: int = RANK_GROUP) -> DataFrame:
    """All rows and columns of ``lengths`` with sequence_id and offset (long).

    ``lengths`` holds ``length`` (1 to ``capacity``) and ``mix`` (any long that
    spreads the rows); it is read three times, so it should be a stored table.
    """
    units = -(-capacity // grid)
    rows = lengths.withColumn("_class", F.ceil(F.col("length") / grid).cast("int"))
    demand = np.zeros(units + 1, dtype=np.int64)
    for r in rows.groupBy("_class").count().collect():
        demand[r["_class"]] = r["count"]
    first, seq, each = _segments(whole_patterns(demand, units), demand)
    starts = np.concatenate([[0], np.cumsum(demand)])
    at_class = lambda values: F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.col("_class") + 1)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("mix", "length"), at_class([max(1, -(-n // rank_group)) for n in demand]).cast("long")))
    before = Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("_class", "_part").count().select("_class", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_ahead"))
    rank = F.row_number().over(Window.partitionBy("_class", "_part").orderBy(*(c for c in lengths.columns if c != "ids")))
    ranked = rows.join(ahead, ["_class", "_part"]).withColumn("_item", at_class(starts[:units + 1]).cast("long") + F.col("_ahead") + rank - 1)

    def run(batches):
        for b in batches:
            item = b.column(b.schema.get_field_index("_item")).to_numpy()
            k = np.searchsorted(first, item, side="right") - 1
            step = item - first[k] if len(item) else item
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq[k] + step // each[k]), pa.array(step % each[k])], names=[*b.schema.names, "sequence_id", "_k"])

    kept = ranked.select(*lengths.columns, "_class", "_item")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    placed = kept.mapInArrow(run, f"{kinds}, sequence_id long, _k long") if len(first) else kept.withColumns({"sequence_id": F.lit(0).cast("long"), "_k": F.lit(0).cast("long")})
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_k").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*lengths.columns, "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, grid: int = GRID, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece of a document.

    A null or empty text has the end id only. Rows that share an id are packed
    each by itself. Texts of any length are cut every ``capacity`` tokens, so
    each sequence holds at most ``capacity`` tokens; what is left of it is
    padding, unless its length is a power of two. An empty table gives an empty
    table. Other columns are not read. ``with_ids`` adds the ids of each piece.
    """
    cut = stored(pieces(docs, path or public_tokenizers.path(VOCABULARY), id_col, text_col, capacity, with_ids=with_ids), "pieces")
    return assign(cut, capacity, grid).drop("mix")
