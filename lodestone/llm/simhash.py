"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at ``radius`` or fewer differing bits. Only
distinct fingerprints are compared, so copies cost nothing. Statistics of all
fingerprints (how often each pair of bits is set together) decide how the bits
are grouped into partitions and, by dynamic programming on the estimated number
of candidates, which threshold each partition gets. If the thresholds sum to
radius - m + 1, two fingerprints within the radius agree in some partition i up
to t_i bits (Qin et al., 2018). Each fingerprint is sent to the keys within t_i
of its value in partition i; what meets under a key is verified.

64 bits tell copies of a similarity of 0.8 from other texts too roughly: they
differ in ten bits. With ``words`` a text gets that many fingerprints of 64
bits each. Candidates then meet in a partition of any of them, planned as
above, and link if all bits together differ in no more than a pair of the
wanted similarity does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components, forest
from lodestone.llm.store import discard, free_names, stored

BITS = 64
#: Fingerprints of one key that are compared in one go; a key with more is dealt out as pairs of blocks.
BLOCK = 512
#: Cost of sending one row to a key, in comparisons.
SEND_COST = 20.0
#: Hashes whose bits are counted in one go.
CHUNK = 16384
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _hashes(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """Unsigned hashes of the word shingles of a UTF-8 text, repeats included; none if it has no word."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, seed) for g in grams], dtype=np.uint64)


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of a UTF-8 text; 0 if it has no word."""
    h = _hashes(text, shingle, seed).astype(">u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k:k + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _scrambled(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit hashes in which every bit depends on all (the finaliser of splitmix64)."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def wide_fingerprint(text: bytes | None, words: int, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """``words`` fingerprints of a UTF-8 text, each from other hashes of the same shingles; zeros if it has no word."""
    h = _hashes(text, shingle, seed)
    step = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(BITS * words, dtype=np.int64)
    for k in range(0, len(h), CHUNK):
        bits = np.unpackbits(_scrambled(h[k:k + CHUNK, None] + step).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # sums of 255 rows fit a byte
            ones += bits[j:j + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")


def most_bits(similarity: float, words: int) -> int:
    """Differing bits that a pair of this similarity of shingle sets has, one standard deviation above the mean.

    Shingle sets of Jaccard similarity s and like size have the cosine
    2s / (1 + s); each bit differs with the chance of that angle over pi.
    """
    n, p = BITS * words, math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.floor(n * p + math.sqrt(n * p * (1 - p)))


def _names(words: int) -> list[str]:
    return [f"w{k}" for k in range(words)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, words: int = 0) -> DataFrame:
    """(doc_id, th, fp): hash of the text and its fingerprint as signed longs.

    With ``words`` their fingerprints follow as w0, w1 ...; fp is a hash of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if words:
                wide = np.array([wide_fingerprint(t.as_py(), words, shingle, seed) for t in b.column(2)], dtype=np.uint64).reshape(-1, words)
                fps = [xxhash.xxh64_intdigest(w.tobytes()) for w in wide]
            else:
                wide, fps = np.zeros((0, 0), dtype=np.uint64), [fingerprint(t.as_py(), shingle, seed) for t in b.column(2)]
            own = [np.array(fps, dtype=np.uint64), *(np.ascontiguousarray(wide[:, k]) for k in range(words))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x.view(np.int64)) for x in own)], names=["doc_id", "th", "fp", *_names(words)])

    fields = ", ".join(f"{c} long" for c in ["doc_id", "th", "fp", *_names(words)])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, fields)


def _as_bits(fp: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones for each fingerprint; column k is the bit of weight 2**k."""
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(fps: DataFrame, columns: list[str] | None = None) -> tuple[int, list[np.ndarray]]:
    """Number of fingerprints, and in each column how many have both bits of a pair set. One pass over all; 64 x 64 sums a column come back."""
    columns = columns or ["fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((len(columns), BITS, BITS)), 0
        for b in batches:
            for c in range(len(columns)):
                x = _as_bits(b.column(c).to_numpy(zero_copy_only=False)).astype(np.float64)
                both[c] += x.T @ x
            n += b.num_rows
        if n:
            k = np.arange(both.size + 1)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["k", "n"])

    both = np.zeros(len(columns) * BITS * BITS + 1)
    for r in fps.select(*columns).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        both[r.k] = r.n
    return int(both[-1]), list(both[:-1].reshape(-1, BITS, BITS))


def _entropy(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1)
    return -p * np.log2(p)


def _information(n: int, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy of each bit and mutual information of each pair."""
    p11 = both / max(n, 1)
    p = np.diag(p11)
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    p00 = 1 - p11 - p10 - p01
    h = _entropy(p) + _entropy(1 - p)
    joint = _entropy(p11) + _entropy(p10) + _entropy(p01) + _entropy(p00)
    return h, np.maximum(0, h[:, None] + h[None, :] - joint)


def _groups(h: np.ndarray, info: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of about equal entropy; each takes the bit that shares most information with it."""
    left, out = set(range(BITS)), []
    for k in range(m):
        want = len(left) if k == m - 1 else round(len(left) / (m - k))
        group = [min(left, key=lambda b: (-sum(info[b, c] for c in left if c != b), b))]
        left.remove(group[0])
        while len(group) < want:
            b = min(left, key=lambda b: (-sum(info[b, c] for c in group), b))
            group.append(b)
            left.remove(b)
        out.append(sorted(group))
    return out


def _group_entropy(g: list[int], h: np.ndarray, info: np.ndarray) -> float:
    """Entropy of a partition under the best tree of pairwise dependencies."""
    tree, rest, total = {g[0]}, set(g[1:]), h[g].sum()
    while rest:
        _, a = max((info[a, b], a) for a in rest for b in tree)
        total -= max(info[a, b] for b in tree)
        tree.add(a)
        rest.remove(a)
    return max(0.0, float(total))


def allocate(cost: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with the given sum and the least cost; ``cost[i][t]`` is the cost of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in row.items():
                if s + t not in nxt or c + x < nxt[s + t][0]:
                    nxt[s + t] = (c + x, [*ts, t])
        best = nxt
    return best[total]


def plan(n: int, both: np.ndarray, radius: int = 3) -> list[tuple[list[int], int]]:
    """Partitions (lists of bits) with their thresholds; a partition of threshold -1 is left out."""
    h, info = _information(n, both)
    best = None
    for m in range(2, radius + 2):
        groups = _groups(h, info, m)
        cost = []
        for g in groups:
            alike, row = 2.0 ** -_group_entropy(g, h, info), {-1: 0.0}
            for t in range(0, radius + 1):
                ball = sum(math.comb(len(g), k) for k in range(t + 1))
                if ball <= 4096:
                    row[t] = n * n / 2 * min(1.0, alike * ball) + SEND_COST * n * ball
            cost.append(row)
        found = allocate(cost, radius - m + 1)
        if best is None or found[0] < best[0]:
            best = (found[0], [(g, t) for g, t in zip(groups, found[1]) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def probe_keys(fp: Column, parts: list[tuple[list[int], int]], first: int = 0) -> Column:
    """Array of (part, value): the values within t_i of the fingerprint's own in each partition i, numbered from ``first``."""
    out = []
    for i, (bits, t) in enumerate(parts, first):
        mask = sum(1 << b for b in bits)
        flips = [0]
        for k in range(t):
            flips += [f | 1 << b for f in list(flips) if f.bit_count() == k for b in bits if f < 1 << b]
        for f in sorted(set(flips)):
            out.append(F.struct(F.lit(i).cast("short").alias("part"), fp.bitwiseXOR(F.lit(_signed(f))).bitwiseAND(F.lit(_signed(mask))).alias("value")))
    return F.array(*out)


def verified_links(keyed: DataFrame, limit: int, columns: list[str] | None = None) -> DataFrame:
    """(a, b): links among fingerprints under the same key, as stars: at most one row for a fingerprint and key.

    ``keyed``: part, value, b1, b2, blk, fp, and the fingerprints in
    ``columns`` (fp itself if none) that differ in at most ``limit`` bits in
    all. Rows of a key are read in sorted runs; a run is bounded because keys
    hold at most two blocks.
    """
    columns = columns or []

    def links(key: np.ndarray, blk: np.ndarray, cross: np.ndarray, fp: np.ndarray, wide: list[np.ndarray]):
        xs, ys, at, d = [], [], np.arange(len(fp)), 1
        while True:
            at = at[at + d < len(fp)]
            at = at[key[at] == key[at + d]]
            if not len(at):
                break
            near = at[(fp[at] != fp[at + d]) & (~cross[at] | (blk[at] != blk[at + d]))]
            differ = np.zeros(len(near), dtype=np.int64)
            for w in wide or [fp]:  # most pairs exceed the limit before the last fingerprint
                differ += np.bitwise_count(w[near] ^ w[near + d])
                ok = differ <= limit
                near, differ = near[ok], differ[ok]
            if len(near):
                xs.append(fp[near])
                ys.append(fp[near + d])
            d += 1
        if not xs:
            return None
        nodes, roots = forest(np.concatenate(xs).view(np.int64), np.concatenate(ys).view(np.int64))
        keep = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(6 + len(columns))]
            held = cols if held is None else [np.concatenate(z) for z in zip(held, cols)]
            part, value, b1, b2, blk, fp, *wide = held
            new = np.ones(len(fp), dtype=bool)
            new[1:] = (part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])
            cut = int(np.flatnonzero(new)[-1]) if len(new) else 0  # the last run may go on in the next batch
            if cut:
                out = links(np.cumsum(new)[:cut], blk[:cut], (b1 != b2)[:cut], fp[:cut].view(np.uint64), [w[:cut].view(np.uint64) for w in wide])
                if out is not None:
                    yield out
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            part, value, b1, b2, blk, fp, *wide = held
            out = links(np.zeros(len(fp), dtype=np.int64), blk, b1 != b2, fp.view(np.uint64), [w.view(np.uint64) for w in wide])
            if out is not None:
                yield out

    order = ["part", "value", "b1", "b2"]
    return (keyed.select(*order, "blk", "fp", *columns).repartition(*order).sortWithinPartitions(*order)
            .mapInArrow(run, "a long, b long"))


def link_components(fps: DataFrame, radius: int = 3, block: int = BLOCK, words: int = 0, limit: int = 0) -> DataFrame:
    """(node, root) of distinct fingerprints ``fp`` that have a link.

    With ``words`` those in w0, w1 ... are probed with ``radius`` each and
    link at ``limit`` or fewer differing bits in all.
    """
    wide = _names(words)
    n, both = bit_statistics(fps, wide)
    keys, parts = [], 0
    for c, one in zip(wide or ["fp"], both):
        own = plan(n, one, radius)
        keys.append(probe_keys(F.col(c), own, parts))
        parts += len(own)
    keyed = fps.select("fp", *wide, F.explode(F.concat(*keys)).alias("k")).select("fp", *wide, "k.part", "k.value")
    hot = stored(keyed.groupBy("part", "value").count().where(F.col("count") > block)
                 .select("part", "value", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "hot-keys")
    # a hot key's rows are dealt to blocks, and each pair of blocks is compared by itself
    j, own = F.col("other"), F.col("blk")
    dealt = (keyed.join(hot, ["part", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("part", "value", F.least(own, j).alias("b1"), F.greatest(own, j).alias("b2"), "blk", "fp", *wide))
    links = stored(verified_links(dealt, limit if words else radius, wide).distinct(), "fp-links")
    out = components(links, "a", "b")
    discard(links)
    return out


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int, radius: int, block: int, words: int = 0, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, th, fp), and for each fingerprint its group: fp, root, component_id."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle, seed, words), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in _names(words))), "fp-classes")
    roots = link_components(classes.select("fp", *_names(words)), radius, block, words, limit)
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows, stored(rooted.join(least, "root").select("fp", "root", "component_id"), "fp-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42,
                    radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    fingerprint: 16 lowercase hex digits. component_id: smallest doc_id that
    the document reaches by links, itself included. A null or empty text has
    fingerprint zero and links like any other; rows with one id or one text are
    rows of the same class; a null id takes the component of its text, which is
    null only if no row there has an id. An empty table gives an empty table.
    Other columns are not read.
    """
    rows, by_fp = _grouped(docs, id_col, text_col, shingle, seed, radius, block)
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42,
                      radius: int = 3, block: int = BLOCK, words: int = 0, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group: the smallest id, then the smallest text hash.

    With ``words`` texts link that agree in a partition of one of so many
    fingerprints (each planned for ``radius``) and whose bits in all differ no
    more than those of texts of this ``similarity`` of shingles. A null or
    empty text has the fingerprint of no word, so one such row stays. A null id
    comes last. Of rows that repeat id and text one stays. An empty table gives
    an empty table.
    """
    rows, by_fp = _grouped(docs, id_col, text_col, shingle, seed, radius, block, words, most_bits(similarity, words))
    last = F.lit(2**63 - 1)
    i, h = free_names(docs, "_id", "_th")
    first = rows.join(by_fp.select("fp", "root"), "fp").groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", last).alias(i), F.col("th").alias(h))).alias("k"))
    own = docs.withColumns({i: F.coalesce(F.col(id_col).cast("long"), last), h: F.xxhash64(text_col)})
    return own.join(first.select("k.*").distinct(), [i, h]).dropDuplicates([i, h]).select(*docs.columns)
