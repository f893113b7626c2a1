"""Language identification by hierarchical discrimination.

Letters of a text give hashed character n-grams; the square roots of their
shares form a vector of length one. Languages are grouped into families by
merging the nearest class means. Linear support vector machines first choose
the family (one against the rest), then the language within it (one against
one, by votes). Families and machines are learned from a bounded sample of
labelled documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 13
NGRAMS = (1, 2, 3)
#: Labelled documents that the machines are fitted on, over all languages.
TRAIN_ROWS = 1000
#: Texts of a language that pass the training filter beyond four times the number taken.
SPARE = 64
EPOCHS = 12
COST = 4.0
#: Slope of the logistic curve that turns the smallest margin into a score.
SLOPE = 4.0
UNDETERMINED = "und"
ROWS_AT_ONCE = 256
_NO_LETTER = re.compile(r"[\W\d_]+")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of 2**BITS hashed n-gram shares of the whole text; None if it has no letter."""
    s = _NO_LETTER.sub(" ", (text or "").lower())
    if not any(map(str.isalpha, s)):
        return None
    c = np.frombuffer(f" {s.strip()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros(1 << BITS)
    for k in range(0, len(c), 1 << 20):  # long texts in parts that overlap by the longest n-gram
        part = c[k:k + (1 << 20) + max(NGRAMS) - 1]
        for n in NGRAMS:
            m = min(len(part) - n + 1, 1 << 20)
            if m > 0:
                h = np.full(m, n, dtype=np.uint32)
                for j in range(n):
                    h = (h ^ part[j:j + m]) * _MIX[j % 3]
                    h ^= h >> np.uint32(15)
                out += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    return np.sqrt(out / out.sum())


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights (bias last) of an L2-loss linear SVM by dual coordinate descent; y is +1 or -1, classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    n_up = max(1, int((y > 0).sum()))
    n_down = max(1, len(y) - n_up)
    c = cost * np.where(y > 0, len(y) / (2 * n_up), len(y) / (2 * n_down))
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    square = np.einsum("ij,ij->i", x, x) + 1 / (2 * c)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + a[i] / (2 * c[i])
            new = max(0.0, a[i] - g / square[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


def group_families(means: np.ndarray) -> list[list[int]]:
    """Classes in about half as many families, by average linkage on the class means."""
    groups = [[k] for k in range(len(means))]
    near = means @ means.T
    while len(groups) > max(1, -(-len(means) // 2)):
        _, i, j = max((near[np.ix_(a, b)].mean(), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[-i] = sorted(groups[-i] + groups.pop(-j))
    return sorted(groups)


@dataclass
class Model:
    languages: list[str]
    families: list[list[int]]
    #: One column for each family, then one for each pair of languages within a family.
    weights: np.ndarray
    pairs: list[tuple[int, int]]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of each row."""
        if len(self.languages) == 1:
            return np.zeros(len(x), dtype=np.int64), np.ones(len(x))
        margin = x @ self.weights[:-1] + self.weights[-1]
        nf = len(self.families) if len(self.families) > 1 else 0
        fam, sure = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
        if nf:
            fam = margin[:, :nf].argmax(axis=1)
            top = np.sort(margin[:, :nf], axis=1)
            sure = (top[:, -1] - top[:, -2]) / 2
        votes = np.full((len(x), len(self.languages)), -1.0)
        for f, members in enumerate(self.families):
            votes[np.ix_(fam == f, members)] = 0
        for k, (a, b) in enumerate(self.pairs):
            m = margin[:, nf + k]
            live = votes[:, a] >= 0
            votes[live & (m >= 0), a] += 1
            votes[live & (m < 0), b] += 1
        best = votes.argmax(axis=1)
        for k, (a, b) in enumerate(self.pairs):
            m = margin[:, nf + k]
            sure = np.where(best == a, np.minimum(sure, m), np.where(best == b, np.minimum(sure, -m), sure))
        return best, 1 / (1 + np.exp(-SLOPE * np.clip(sure, -50, 50)))


def fit(x: np.ndarray, labels: list[str]) -> Model | None:
    languages = sorted(set(labels))
    if not languages:
        return None
    y = np.array([languages.index(v) for v in labels])
    means = np.array([x[y == k].mean(axis=0) for k in range(len(languages))])
    families = group_families(means / np.linalg.norm(means, axis=1, keepdims=True))
    of = {k: f for f, g in enumerate(families) for k in g}
    fam = np.array([of[k] for k in y])
    cols = [fit_svm(x, np.where(fam == f, 1, -1)) for f in range(len(families))] if len(families) > 1 else []
    pairs = [(a, b) for g in families for i, a in enumerate(g) for b in g[i + 1:]]
    for a, b in pairs:
        own = (y == a) | (y == b)
        cols.append(fit_svm(x[own], np.where(y[own] == a, 1, -1)))
    return Model(languages, families, np.array(cols).T if cols else np.zeros((x.shape[1] + 1, 0)), pairs)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is a multiple of five; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def has_letter(text: Column) -> Column:
    """Whether a text has a letter; false for null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model | None:
    """Model of at most ``rows`` documents that are not held out, the same number of distinct texts from each language.

    Which ones is decided by a hash of the text: a share of each language that
    holds enough is kept by a filter, the smallest hashes of it are taken. All
    copies of a text pass or fail together, so the share is that of the distinct
    texts with a letter; ``SPARE`` keeps it wide enough where few are taken.
    """
    usable = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & has_letter(F.col(text_col)))
    h = F.xxhash64(F.lit(11), text_col)
    distinct = usable.groupBy(F.col(lang_col).alias("lang"), h.alias("h")).agg(F.lit(1).alias("one"))
    sizes = {r[0]: r[1] for r in distinct.groupBy("lang").count().collect()}
    if not sizes:
        return None
    each = max(1, rows // len(sizes))
    share = sum((F.when(F.col(lang_col) == v, F.lit(min(1.0, (4 * each + SPARE) / n))).otherwise(0.0) for v, n in sizes.items()), F.lit(0.0))
    some = (usable.where(F.pmod(h, F.lit(1 << 20)) < share * (1 << 20)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), h.alias("h"))
            .groupBy("lang", "h").agg(F.min("t").alias("t"))
            .withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each))

    def run(batches):
        for b in batches:
            for lang, h, t in zip(b.column(0), b.column(1), b.column(2)):
                x = features(t.as_py())
                if x is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), pa.array([h.as_py()]), pa.array([x.astype(np.float32)])], names=["lang", "h", "x"])

    got = some.select("lang", "h", "t").mapInArrow(run, "lang string, h long, x array<float>").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    if not got.num_rows:
        return None
    return fit(got.column("x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1), got.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All rows and columns of ``docs`` with the predicted language and its score in two more columns.

    A text that is null or has no letter is ``und`` with score 0, and so is
    every text if nothing was learned. Only the text is read for a prediction.
    An empty table gives an empty table; columns named as in ``into`` are replaced.
    """
    docs = docs.select(*(c for c in docs.columns if c.lower() not in into))
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            for k in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(k, ROWS_AT_ONCE)
                lang, score = [UNDETERMINED] * part.num_rows, [0.0] * part.num_rows
                xs = [features(t.as_py()) for t in part.column(at)]
                found = [i for i, x in enumerate(xs) if x is not None]
                if model is not None and found:
                    for i, best, sure in zip(found, *model.predict(np.array([xs[i] for i in found]))):
                        lang[i], score[i] = model.languages[best], float(sure)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, *into])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{columns}, `{into[0]}` string, `{into[1]}` double")
