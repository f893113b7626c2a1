"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block becomes a vector: its tag path
and its words, hashed, and a few measures of its text. A bidirectional LSTM in
numpy reads the whole sequence, so that every block is judged in the context of
the document, and gives the probability that a block is main text.

There are no labelled pages, so the labeller is trained on pages whose mark-up
tells: blocks inside an article or main element are main text, blocks inside
navigation, footers, adverts and the like are not. In training the names of
these elements vary at random or are taken away, and foreign prose is put into
boilerplate, so that the labeller learns the names, the texts and the context
rather than one page layout.
"""

from __future__ import annotations

import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.html_blocks import Block, parse

PATH_DIMS, WORD_DIMS, MEASURES = 64, 16, 5
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
HIDDEN = 12
#: Pages that the labeller is trained on, and blocks of each that it sees then.
TRAIN_PAGES = 192
TRAIN_BLOCKS = 120
#: Steps of training; the fewer pages, the more often each is seen.
STEPS = 200
BATCH = 32
PAGES_AT_ONCE = 256
#: Blocks (padding included) that are labelled at once.
BLOCKS_AT_ONCE = 1 << 16

MAIN = ["article", "main", ".content", ".post", ".entry", ".story"]
BOILERPLATE = ["nav", "footer", "header", "aside", "form", "menu", "dialog", ".ad", ".ads", ".advert", ".advertisement", ".sponsored", ".sidebar", ".comment", ".comments", ".notice", ".cookie",
               ".consent", ".banner", ".promo", ".related", ".recommended", ".share", ".social", ".menu", ".nav", ".navigation", ".navbar", ".breadcrumb", ".breadcrumbs", ".newsletter",
               ".subscribe", ".popup", ".footer", ".header", ".widget", ".login", ".search", ".reply", ".respond", ".discussion", ".disclaimer", ".copyright"]
_MAIN, _BOILER = frozenset(MAIN), frozenset(BOILERPLATE)


@lru_cache(maxsize=1 << 14)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIMS)
    for token in path:
        h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        v[h % PATH_DIMS] += 1 if h >> 31 else -1
    return np.clip(v, -2, 2)


def vector(b: Block) -> np.ndarray:
    v = np.empty(DIMS)
    v[:PATH_DIMS] = _path_vector(b.path)
    words = b.text.encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    v[PATH_DIMS:PATH_DIMS + WORD_DIMS] = np.bincount(h % WORD_DIMS, np.where(h >> 31, 1.0, -1.0), WORD_DIMS) / (1 + len(words))
    n = len(b.text)
    v[-MEASURES:] = np.log1p(n) / 6, b.linked / n, b.text.count(".") / (1 + len(words)), b.text[-1] in ".!?", b.path[-1][:1] == "h" if b.path else 0
    return v


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Lstm:
    """One direction; arrays are (blocks, pages, size), a mask of zeros stops the state at the end of a page."""

    @staticmethod
    def forward(p: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        t, b, _ = x.shape
        h, c, hs, kept = np.zeros((b, HIDDEN)), np.zeros((b, HIDDEN)), np.zeros((t, b, HIDDEN)), []
        zx = x @ p["wx"] + p["b"]
        for k in range(t):
            z = zx[k] + h @ p["wh"]
            gates, g, m = _sigmoid(z[:, :3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN:]), mask[k][:, None]
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                kept.append((h, c, i, f, o, g, tc, m))
            h, c = m * o * tc + (1 - m) * h, m * new + (1 - m) * c
            hs[k] = h
        return hs, kept

    @staticmethod
    def backward(p: dict, x: np.ndarray, kept: list, dhs: np.ndarray) -> dict:
        g_out = {k: np.zeros_like(v) for k, v in p.items()}
        dh = dc = np.zeros(dhs.shape[1:])
        for k in range(len(kept) - 1, -1, -1):
            h0, c0, i, f, o, g, tc, m = kept[k]
            dh = dh + dhs[k]
            dnew = m * (dc + dh * o * (1 - tc * tc))
            dz = np.hstack([dnew * g * i * (1 - i), dnew * c0 * f * (1 - f), m * dh * tc * o * (1 - o), dnew * i * (1 - g * g)])
            g_out["wx"] += x[k].T @ dz
            g_out["wh"] += h0.T @ dz
            g_out["b"] += dz.sum(axis=0)
            dh, dc = (1 - m) * dh + dz @ p["wh"].T, (1 - m) * dc + dnew * f
        return g_out


class Labeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        one = lambda: {"wx": rng.normal(0, 0.15, (DIMS, 4 * HIDDEN)), "wh": rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), "b": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        self.parts = {"there": one(), "back": one(), "out": {"w": rng.normal(0, 0.2, 2 * HIDDEN), "b": np.zeros(1)}}

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        a, ka = Lstm.forward(self.parts["there"], x, mask, keep)
        b, kb = Lstm.forward(self.parts["back"], x[::-1], mask[::-1], keep)
        h = np.concatenate([a, b[::-1]], axis=2)
        return _sigmoid(h @ self.parts["out"]["w"] + self.parts["out"]["b"]), h, ka, kb

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, state: dict, rate: float) -> float:
        p, h, ka, kb = self.forward(x, mask, keep=True)
        dz = (p - y) * mask / max(1.0, mask.sum())
        dh = dz[:, :, None] * self.parts["out"]["w"]
        grads = {"there": Lstm.backward(self.parts["there"], x, ka, dh[:, :, :HIDDEN]), "back": Lstm.backward(self.parts["back"], x[::-1], kb, dh[::-1, :, HIDDEN:]),
                 "out": {"w": (h * dz[:, :, None]).sum(axis=(0, 1)), "b": np.array([dz.sum()])}}
        state["t"] = t = state.get("t", 0) + 1
        for part, gs in grads.items():
            for k, g in gs.items():
                m, v = state.get((part, k), (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                state[part, k] = m, v
                self.parts[part][k] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return float(-(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / max(1.0, mask.sum()))

    def main_blocks(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page which blocks are main text; pages of like length are labelled together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < PAGES_AT_ONCE and len(pages[order[end]]) * (end - at + 1) <= BLOCKS_AT_ONCE:
                end += 1
            group = order[at:end]
            x, mask = stacked([[vector(b) for b in pages[k]] for k in group])
            p = self.forward(x, mask)[0]
            for j, k in enumerate(group):
                out[k] = p[:len(pages[k]), j] > 0.5
            at = end
        return out


def stacked(pages: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), DIMS))
    mask = np.zeros(x.shape[:2])
    for j, vs in enumerate(pages):
        x[:len(vs), j] = vs
        mask[:len(vs), j] = 1
    return x, mask


def told(path: tuple[str, ...]) -> bool:
    """Whether the mark-up says that a block is main text."""
    return not _MAIN.isdisjoint(path) and _BOILER.isdisjoint(path)


def nameless(rng: random.Random) -> tuple[str, ...]:
    """A part of a page whose mark-up says nothing: a plain division, or one with a class word of its own."""
    tag = rng.choice(["div", "div", "div", "section", "td"])
    return (tag,) if rng.random() < 0.5 else (tag, f".{rng.choice('bcdfgklmnprstvz')}{rng.randrange(1 << 20):x}")


def varied(page: list[Block], prose: list[str], rng: random.Random) -> tuple[list[Block], list[bool]]:
    """A page for training with other names for its parts, and with prose put into boilerplate at random places.

    On half of the pages the main text has no telling name, on half the
    boilerplate of the page has none; there only texts and neighbours tell.
    """
    bare, hidden = rng.random() < 0.5, rng.random() < 0.5
    name = nameless(rng) if bare else rng.choice([("article",), ("main",), ("div", rng.choice(MAIN[2:])), ("section", rng.choice(MAIN[2:])), ("main", "article")])
    top = ("html", "body")

    def boiler(inside: bool, hidden: bool = False) -> tuple[str, ...]:
        if hidden:
            return top + name * inside + nameless(rng)
        b = rng.choice(BOILERPLATE)
        return top + name * inside + ((rng.choice(["div", "div", "section", "ul"]), b) if b[0] == "." else (b,))

    blocks, labels, wrap = [], [], boiler(False, hidden)
    for k, b in enumerate(page):
        main = told(b.path)
        if k == 0 or main != labels[-1]:
            wrap = boiler(rng.random() < 0.2, hidden)
        tail = b.path[-1:] if b.path and b.path[-1] in ("p", "li", "h1", "h2", "h3", "blockquote", "td") else ()
        blocks.append(b._replace(path=(top + name if main else wrap) + tail))
        labels.append(main)
        if prose and rng.random() < 0.06:  # prose of another page can only be told by a name
            extra = boiler(main and rng.random() < 0.5)
            for _ in range(rng.randint(1, 3)):
                blocks.append(Block(extra + rng.choice([("p",), ("p",), ("li",), ()]), rng.choice(prose), 0))
                labels.append(False)
    return blocks, labels


def window(page: list[Block]) -> list[Block]:
    """``TRAIN_BLOCKS`` blocks of a page, the first main block in their middle if there are enough on both sides."""
    first = next(k for k, b in enumerate(page) if told(b.path))
    at = max(0, min(first - TRAIN_BLOCKS // 2, len(page) - TRAIN_BLOCKS))
    return page[at:at + TRAIN_BLOCKS]


def train_on(pages: list[list[Block]], steps: int = STEPS, seed: int = 5) -> Labeller | None:
    """Labeller fitted to pages in which the mark-up tells some main text; None if there is none to learn from."""
    pages = [window(p) for p in pages if any(told(b.path) for b in p)]
    if not pages:
        return None
    rng, model, state = random.Random(seed), Labeller(), {}
    prose = [b.text for p in pages for b in p if told(b.path)][:2000]
    epochs = -(-steps // -(-len(pages) // BATCH))
    for epoch in range(epochs):
        rng.shuffle(pages)
        for k in range(0, len(pages), BATCH):
            made = [varied(p, prose, rng) if rng.random() < 0.8 else (p, [told(b.path) for b in p]) for p in pages[k:k + BATCH]]
            x, mask = stacked([[vector(b) for b in bs] for bs, _ in made])
            y = np.zeros(mask.shape)
            for j, (_, labels) in enumerate(made):
                y[:len(labels), j] = labels
            model.step(x, mask, y, state, 0.02 if epoch < epochs * 2 // 3 else 0.005)
    return model


def train(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", sample: int = TRAIN_PAGES) -> Labeller | None:
    """Labeller trained on at most ``sample`` pages, those with the smallest hashes of id and address.

    A filter on the hash leaves a few times as many, whatever the number of
    pages, and pages with one id and address count once; so the tasks have
    little to send. None where none of them tells its main text.
    """
    h = F.xxhash64(F.lit(1), id_col, url_col)
    share = min(1.0, 8 * sample / max(1, pages.count()))
    some = pages.where(F.col(html_col).isNotNull() & (F.pmod(h, F.lit(1 << 30)) < share * (1 << 30))).select(h.alias("h"), F.col(html_col).alias("html"))
    return train_on([parse(r.html) for r in some.groupBy("h").agg(F.min("html").alias("html")).orderBy("h").limit(sample).collect()])


def extract(pages: DataFrame, model: Labeller | None, html_col: str = "html", into: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` with the main text of each in ``into``: its main blocks in page order, joined by \\n.

    A null or empty page, or one without main text, has the empty text; without
    a model, which no page could teach, every page has. Pages
    of any length are read whole and labelled as one sequence. Rows are taken by
    themselves; an empty table gives an empty table; a column of ``pages`` named
    as ``into`` is replaced.
    """
    pages = pages.select(*(c for c in pages.columns if c.lower() != into.lower()))
    if model is None:
        return pages.withColumn(into, F.lit(""))
    at = pages.columns.index(html_col)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            for k in range(0, b.num_rows, PAGES_AT_ONCE):
                part = b.slice(k, PAGES_AT_ONCE)
                blocks = [parse(t.as_py() or "") for t in part.column(at)]
                texts = ["\n".join(x.text for x, keep in zip(p, main) if keep) for p, main in zip(blocks, model.main_blocks(blocks))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, into])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{columns}, `{into}` string")
