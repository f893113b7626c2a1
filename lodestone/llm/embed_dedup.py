"""Near-duplicate vectors by cosine, compared in tiles along the principal axes.

Equal vectors form one class, so copies are compared once. One pass sums the
outer products of all unit vectors; the eigenvectors of that d x d matrix order
the axes by energy. Vectors are dealt to cells by quantiles of the two leading
coordinates and, in each cell, to blocks of bounded size. Cells that lie
farther apart than two linked unit vectors can are never paired. A pair of
blocks is one task: it adds up the leading axes first, bounds what the other
axes can still add by the product of the suffix norms, and goes on only with
pairs that can reach the threshold. Survivors are decided by the plain cosine
of the original vectors in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components, forest
from lodestone.llm.store import stored

#: Vectors of a block; a task holds two blocks.
BLOCK = 2048
#: Most quantile steps along each of the two leading axes (so at most 256 cells).
MAX_STEPS = 16
#: Rows and columns of the inner tile.
TILE = 512
SLACK = 1e-9


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i of a, j of b) of all pairs of unit vectors with cosine >= threshold; if ``same``, only i < j."""
    d = a.shape[1]
    steps = [k for k in (max(1, d // 4), max(1, d // 2), max(1, 3 * d // 4)) if k < d] + [d]
    ra, rb = a @ axes, b @ axes
    left = lambda r: np.sqrt(np.maximum(0, np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1]))  # noqa: E731  norm of what follows axis k
    sa, sb = (np.hstack([left(r), np.zeros((len(r), 1))]) for r in (ra, rb))
    out_i, out_j = [], []
    for p in range(0, len(a), TILE):
        for q in range(p if same else 0, len(b), TILE):
            xa, xb, ta, tb = ra[p:p + TILE], rb[q:q + TILE], sa[p:p + TILE], sb[q:q + TILE]
            k = steps[0]
            acc = xa[:, :k] @ xb[:, :k].T
            alive = acc + np.outer(ta[:, k], tb[:, k]) >= threshold - SLACK
            if same and p == q:
                alive &= np.triu(np.ones(alive.shape, dtype=bool), 1)
            i, j = np.nonzero(alive)
            s = acc[i, j]
            for lo, hi in zip(steps, steps[1:]):
                if not len(i):
                    break
                s = s + np.einsum("ij,ij->i", xa[i, lo:hi], xb[j, lo:hi])
                ok = s + ta[i, hi] * tb[j, hi] >= threshold - SLACK
                i, j, s = i[ok], j[ok], s[ok]
            out_i.append(i + p)
            out_j.append(j + q)
    return (np.concatenate(z) if z else np.zeros(0, dtype=np.int64) for z in (out_i, out_j))


def _principal_axes(classes: DataFrame, d: int) -> np.ndarray:
    """Axes in columns, most energy first. d x d sums come back from the one pass."""
    def run(batches):
        both, n = np.zeros((d, d)), 0
        for b in batches:
            if len(b):
                x = _unit(_matrix(b.column(0)))
                both += x.T @ x
                n += len(b)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(both.ravel())], names=["k", "s"])

    both = np.zeros(d * d)
    for r in classes.select("v").mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
        both[r.k] = r.s
    _, axes = np.linalg.eigh(both.reshape(d, d))
    return np.ascontiguousarray(axes[:, ::-1])


def _cells(classes: DataFrame, axes: np.ndarray, block: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Classes with cell, block and their two leading coordinates; pairs of cells (at most 256 x 256 rows)."""
    spark = classes.sparkSession
    lead = np.zeros((len(axes), 2))
    lead[:, :min(2, axes.shape[1])] = axes[:, :2]

    def run(batches):
        for b in batches:
            if len(b):
                p = _unit(_matrix(b.column(2))) @ lead
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p[:, 0]), pa.array(p[:, 1])], names=["cid", "mult", "v", "p0", "p1"])

    kind = classes.schema["v"].dataType.simpleString()
    placed = stored(classes.select("cid", "mult", "v").mapInArrow(run, f"cid long, mult long, v {kind}, p0 double, p1 double"), "vectors")
    n = placed.count()
    g = max(1, min(MAX_STEPS, round(math.sqrt(n / block))))
    cuts = placed.agg(*(F.percentile_approx(c, [k / g for k in range(1, g)] or [0.5], 10000) for c in ("p0", "p1"))).first()
    step = lambda c, qs: sum((F.when(F.col(c) > q, 1).otherwise(0) for q in qs[:g - 1]), F.lit(0))
    placed = placed.withColumn("cell", (step("p0", cuts[0] or []) * g + step("p1", cuts[1] or [])).cast("int"))
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k}{c}") for c in ("p0", "p1") for k, f in (("lo", F.min), ("hi", F.max)))).collect()
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    pairs = []
    for x in boxes:
        for y in boxes:
            gap = [max(0.0, x[f"lo{c}"] - y[f"hi{c}"], y[f"lo{c}"] - x[f"hi{c}"]) for c in ("p0", "p1")]
            if math.hypot(*gap) <= reach:
                pairs.append((x.cell, -(-x.n // block), y.cell, -(-y.n // block)))
    return placed, spark.createDataFrame(pairs, "cell int, blocks long, other int, other_blocks long")


def _links_of_one_length(classes: DataFrame, d: int, threshold: float, block: int) -> DataFrame:
    """(cid, n_links, root): for each class with links in a pair of blocks the links found there and the smallest class reached there."""
    axes = _principal_axes(classes, d)
    placed, pairs = _cells(classes, axes, block, threshold)
    blk = lambda cell, k: F.col(cell).cast("long") * F.lit(1 << 40) + k
    dealt = (placed.drop("p0", "p1").join(F.broadcast(pairs), "cell")
             .withColumn("blk", blk("cell", F.pmod(F.xxhash64("cid"), F.col("blocks"))))
             .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_blocks") - 1)))
             .withColumn("against", blk("other", F.col("k")))
             .select(F.least("blk", "against").alias("b1"), F.greatest("blk", "against").alias("b2"), "blk", "cid", "mult", "v"))

    def run(t: pa.Table) -> pa.Table:
        b1, b2, own = (t.column(c).to_numpy() for c in ("b1", "b2", "blk"))
        same = bool(b1[0] == b2[0])
        at = [np.arange(t.num_rows)] * 2 if same else [np.flatnonzero(own == b1[0]), np.flatnonzero(own == b2[0])]
        x, cid, mult = _matrix(t.column("v")), t.column("cid").to_numpy(), t.column("mult").to_numpy()
        u = _unit(x) if len(x) else x
        i, j = linked_pairs(u[at[0]], u[at[1]], axes, threshold, same)
        i, j = at[0][i], at[1][j]
        ok = np.zeros(len(i), dtype=bool)
        for k in range(0, len(i), 65536):
            s = slice(k, k + 65536)
            ok[s] = np.einsum("ij,ij->i", u[i[s]], u[j[s]]) >= threshold
        i, j = i[ok], j[ok]
        n = np.bincount(i, mult[j], len(own)) + np.bincount(j, mult[i], len(own))
        node, root = forest(cid[i], cid[j]) if len(i) else (np.zeros(0, dtype=np.int64),) * 2
        hit = np.flatnonzero(n)
        return pa.table({"cid": cid[hit], "n_links": n[hit].astype(np.int64), "root": root[np.searchsorted(node, cid[hit])] if len(hit) else node})

    return dealt.groupBy("b1", "b2").applyInArrow(run, "cid long, n_links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    n_links: other vectors with cosine >= ``threshold``, equal ones included;
    component_id: smallest id reachable by links, the own one included; kept:
    whether that is the own id. A vector that is null, empty, zero or holds a
    null or non-finite component links with nothing, nor does a row without id
    (component_id null, kept false). Only vectors of one length are compared.
    Rows that share an id are one vertex: their links are united. An empty table
    gives an empty table. Other columns are not read.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    usable = v.isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("v", F.when(usable, v))
    classes = stored(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("mult")), "vector-classes")
    found = None
    for d in sorted(r[0] for r in classes.select(F.size("v").alias("d")).distinct().collect()):
        one = _links_of_one_length(classes.where(F.size("v") == d), d, threshold, block)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = stored(found, "vector-links")
    roots = components(found, "cid", "root")
    links = found.groupBy("cid").agg(F.sum("n_links").alias("more"))
    by_class = (classes.join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
                .select("v", F.col("mult") - 1 + F.coalesce("more", F.lit(0)), F.coalesce("root", "cid")).toDF("v", "n_links", "component_id"))
    comp = F.coalesce("component_id", "vec_id")
    return rows.join(by_class, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"),
                                                   F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1), n AS (SELECT x, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
