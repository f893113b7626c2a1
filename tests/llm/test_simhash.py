import numpy as np
import pytest
import xxhash

from lodestone.llm import simhash as S
from lodestone.llm.components import components


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, w = [], ""
    for c in low + " ":
        if c in " \t\n\r\x0b\x0c":
            words, w = words + [w] * bool(w), ""
        else:
            w += c
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[k:k + 3]) for k in range(len(words) - 2)]
    hs = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    comp = {k: k for k in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return comp


TEXTS = [None, "", " \t\n", "one", "one two", "One TWO", "a b c", "a b c d", "É été straße", "x" * 5000, "w " * 20000, "a\x0bb\x1cc d", "a b c"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert S.fingerprint(None if text is None else text.encode()) == brute_fp(text)


def test_whole_operator_against_brute_force(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(3, "one", "y", 2), (None, "one", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, part int")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()]
    comp = brute_components({k: brute_fp(t) for k, t in enumerate(TEXTS)})
    want = [(k, format(brute_fp(t), "016x"), comp[k]) for k, t, *_ in rows if k is not None] + [(None, format(brute_fp("one"), "016x"), 3)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_one_of_each_group(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(3, "one", "y", 2), (3, "quite another text", "z", 0), (None, "some text without id", None, None), (0, None, "again", 5)]
    got = sorted((str(r.doc_id), r.text) for r in S.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, _id string, _TH int")).collect())
    comp = brute_components({k: brute_fp(t) for k, t in enumerate(TEXTS)})
    want = [(str(k), t) for k, t in enumerate(TEXTS) if comp[k] == k] + [("3", "quite another text"), ("None", "some text without id")]
    assert [g[0] for g in got] == sorted(w[0] for w in want) and {g[1] for g in got} <= {w[1] for w in want} | {"one"}


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("block", [8, 512])
def test_dense_groups_and_chains(spark, block):
    """Copies a few bits off one centre (a hot key in every partition), chains and noise; hot keys in blocks of 8 too."""
    rng = np.random.default_rng(5)
    fps = set()
    for n in (150, 60):
        c = int(rng.integers(0, 2**63))
        for _ in range(n):
            fps.add(c ^ sum({1 << int(b) for b in rng.integers(0, 64, 5)}))
    c = int(rng.integers(0, 2**63))
    for k in range(0, 60, 3):
        c ^= 0b111 << k
        fps.add(c)
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)}
    fps = sorted(S._signed(x) for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in S.link_components(df, block=block).collect()}
    want = brute_components({x: x & (2**64 - 1) for x in fps})
    assert {x: got.get(x, x) for x in fps} == want


@pytest.mark.parametrize("n", [100, 10**6, 10**10])
def test_plan_keeps_the_pigeonhole_sum(n):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (500, 64)).astype(float)
    x[:, 1] = x[:, 0]
    parts = S.plan(n, x.T @ x / 500 * n)
    held = [b for g, _ in parts for b in g]
    assert len(set(held)) == len(held)
    m = {2: 2, 3: 3, 4: 4}
    assert any(sum(t for _, t in parts) - (k - len(parts)) == 3 - k + 1 for k in m if k >= len(parts))


def test_threshold_table_is_optimal():
    cost = [{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 1, 1: 2}, {-1: 0, 0: 4, 1: 90}]
    assert S.allocate(cost, 0)[0] == min(a + b + c for i, a in cost[0].items() for j, b in cost[1].items() for k, c in cost[2].items() if i + j + k == 0)


def test_components_of_chain_star_and_ring(spark):
    e = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(200 + k, 200 + (k + 1) % 9) for k in range(9)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "a long, b long"), "a", "b").collect()}
    want = {k: 0 for k in range(51)} | {k: 100 for k in range(100, 160)} | {k: 200 for k in range(200, 209)}
    assert got == want


WORDS = 8


def brute_wide(text, words=WORDS):
    """All bits of the wide fingerprint as one number, hash by hash."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x1c", "\x00")
    w = [x for x in low.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    grams = [] if not w else [" ".join(w)] if len(w) < 5 else [" ".join(w[k:k + 5]) for k in range(len(w) - 4)]
    out, m = 0, 2**64 - 1
    for k in range(1, words + 1):
        hs = []
        for g in grams:
            h = (xxhash.xxh64(g.replace("\x00", "\x1c").encode(), 42).intdigest() + k * 0x9E3779B97F4A7C15) & m
            h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & m
            h = ((h ^ h >> 27) * 0x94D049BB133111EB) & m
            hs.append(h ^ h >> 31)
        out |= sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) << 64 * (k - 1)
    return out


def brute_wide_components(texts, limit=None):
    """id -> smallest id reached by pairs whose wide fingerprints differ in at most ``limit`` bits."""
    limit = S.most_bits(0.8, WORDS) if limit is None else limit
    fps = {i: brute_wide(t) for i, t in texts.items()}
    comp, changed = {i: i for i in fps}, True
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= limit]
    while changed:
        changed = False
        for a, b in links:
            if comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    return comp


@pytest.mark.parametrize("text", TEXTS + ["a b c d e f g A B", "q " * 600 + "r s t u v"])
def test_wide_fingerprint(text):
    got = S.wide_fingerprint(None if text is None else text.encode(), WORDS)
    assert sum(int(x) << 64 * k for k, x in enumerate(got)) == brute_wide(text)


def edited(rng, words, rate, vocab):
    return [vocab[int(rng.integers(len(vocab)))] if rng.random() < rate else w for w in words]


def similarity(a, b):
    a, b = ({tuple(x[k:k + 5]) for k in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_of_known_similarity(spark):
    """Of pairs of similarity 0.8 and more at least nine in ten lose one text, of unrelated texts and those below 0.6 none."""
    rng = np.random.default_rng(8)
    vocab = [f"word{k}" for k in range(3000)]
    pairs = []
    for k in range(240):
        a = [vocab[int(x)] for x in rng.integers(0, len(vocab), int(rng.integers(60, 500)))]
        pairs.append((a, edited(rng, a, 0.002 * (k % 40), vocab)))
    rows = [(2 * k + j, " ".join(p[j])) for k, p in enumerate(pairs) for j in (0, 1)]
    kept = {r.doc_id for r in S.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, words=WORDS).collect()}
    assert all(2 * k in kept for k in range(len(pairs)))
    sim = {2 * k + 1: similarity(*p) for k, p in enumerate(pairs)}
    near, far = [i for i, s in sim.items() if s >= 0.8], [i for i, s in sim.items() if s < 0.6]
    assert len(near) > 40 and len(far) > 40
    assert sum(i not in kept for i in near) >= 0.9 * len(near) and all(i in kept for i in far)


@pytest.mark.parametrize("block", [8, 512])
def test_wide_groups_against_brute_force(spark, block):
    """A dense group of near copies, chains of edits, copies, texts without words; clashing names and hot keys in blocks."""
    rng = np.random.default_rng(9)
    vocab = [f"w{k}" for k in range(400)]
    centre = [vocab[int(x)] for x in rng.integers(0, 400, 300)]
    texts = [" ".join(edited(rng, centre, 0.004, vocab)) for _ in range(60)]
    step = [vocab[int(x)] for x in rng.integers(0, 400, 200)]
    for _ in range(12):
        step = edited(rng, step, 0.008, vocab)
        texts.append(" ".join(step))
    texts += [None, "", " \n", "one", "ONE", "one two", texts[3], texts[3].upper()]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [(3, texts[3], "again", None)], "doc_id long, text string, w0 string, fp int")
    got = {r.doc_id for r in S.one_of_each_group(df, shingle=5, words=WORDS, block=block).collect()}
    comp = brute_wide_components(dict(enumerate(texts)))
    assert got == {k for k in comp if comp[k] == k}


def test_wide_empty_table(spark):
    assert S.one_of_each_group(spark.createDataFrame([], "doc_id long, text string"), words=WORDS).count() == 0
