import numpy as np
import pytest

from lodestone.llm import html_extract as H
from lodestone.llm.html_blocks import parse


@pytest.mark.parametrize("html,texts", [
    ("", []), ("plain  text\n here", ["plain text here"]), ("<p>a<b>b</b> c<br>d<p>e</div>f", ["ab c d", "e", "f"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]), ("<script>var t='</p>';<p>x</script>y<style>p{}</style>", ["y"]), ("<SCRIPT>a", []),
    ("a &amp; b &copy; &nbsp;c &#233;&lt;p>", ["a & b © c é<p>"]), ("<!-- <p>x</p> -->y<!-- z", ["y"]), ("<!DOCTYPE html><?xml x?>1 < 2 <3", ["1 < 2 <3"]),
    ("<p title='a>b' class=\"x>y\">t</p>", ["t"]), ("<p title='a>t", ["t"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("<title>t</title>x", ["x"])])
def test_blocks(html, texts):
    assert [b.text for b in parse(html)] == texts


def test_paths_and_links():
    got = parse("<article class='Post big'><p>x <a href=/>link</a></p><form id=s><label>l</label></form></article>")
    assert [b.path for b in got] == [("article", ".post", ".big", "p"), ("article", ".post", ".big", "form", ".s", "label")]
    assert got[0].linked == 4


def test_gradients():
    rng = np.random.default_rng(0)
    x, mask, y = rng.normal(size=(5, 3, H.DIMS)), np.ones((5, 3)), rng.integers(0, 2, (5, 3)).astype(float)
    mask[3:, 1] = 0

    def loss(m):
        p = m.forward(x, mask)[0]
        return float(-(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum())

    m, state = H.Labeller(1), {}
    before = {(a, k): v.copy() for a, p in m.parts.items() for k, v in p.items()}
    H.Labeller.step(m, x, mask, y, state, 0.0)
    for (part, k), v in before.items():
        g = state[part, k][0] * 10
        at = tuple(rng.integers(0, s) for s in v.shape)
        m.parts[part][k][at] += 1e-5
        up = loss(m)
        m.parts[part][k][at] -= 2e-5
        down = loss(m)
        m.parts[part][k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_given_pages_and_unseen_layouts(spark, data):
    df = spark.read.parquet(f"{data}/pages.parquet")
    model = H.train(df)
    for r in H.extract(df, model).collect():
        assert r.text == "\n".join(b.text for b in parse(r.html) if H.told(b.path))
    import random
    rng, pages = random.Random(77), [parse(r.html) for r in df.collect()]
    prose = [b.text for p in pages for b in p if H.told(b.path)]
    made = [H.varied(p, prose, rng) for p in pages]
    wrong = sum((got != np.array(want)).sum() for got, (_, want) in zip(model.main_blocks([b for b, _ in made]), made))
    assert wrong < 0.02 * sum(len(b) for b, _ in made)
    alone = [model.main_blocks([p])[0] for p in pages[:20]]
    assert all((a == b).all() for a, b in zip(alone, model.main_blocks(pages)[:20]))


def test_odd_rows(spark, data):
    model = H.train(spark.read.parquet(f"{data}/pages.parquet"))
    rows = [(1, "u", None, "x"), (1, "u", "", "y"), (None, None, "<p>", None), (2, "v", "<article><p>" + "word " * 400000 + "</article>", "z")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    assert [len(r.text) for r in got] == [0, 0, 0, 5 * 400000 - 1]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string"), H.train_on([])).count() == 0


def plain(path):
    """Every part a division without class words, wrapped as the generator of training pages never does."""
    parts = ("article", "main", "nav", "aside", "header", "footer", "section", "form", "menu", "dialog")
    kept = tuple("div" if x in parts else x for x in path if x[0] != ".")
    return kept[:2] + ("center", "div") + kept[2:]


def tables(path):
    """Parts as cells of a layout table."""
    parts = ("article", "main", "nav", "aside", "header", "footer", "section", "form", "div")
    return ("html", "body", "table", "tr") + tuple("td" if x in parts else x for x in path[2:] if x[0] != ".")


def unnamed_main(path):
    """Boilerplate keeps its names, main text has a class word of its own."""
    return tuple("div" if x in ("article", "main") else ".zq17" if x in H.MAIN else x for x in path)


@pytest.mark.parametrize("renamed", [plain, tables, unnamed_main])
def test_pages_without_telling_names(renamed):
    import pyarrow.parquet as pq
    read = lambda sf: [parse(r["html"]) for r in pq.read_table(f"/root/testdata/{sf}/pages.parquet").to_pylist()]
    seen, pages = read("sf0.001"), read("sf0.01")[100:200]
    found = main = both = 0
    for p, got in zip(pages, H.train_on(seen).main_blocks([[b._replace(path=renamed(b.path)) for b in p] for p in pages])):
        for b, keep in zip(p, got):
            found, main, both = found + len(b.text) * keep, main + len(b.text) * H.told(b.path), both + len(b.text) * (keep and H.told(b.path))
    assert both >= 0.9 * main and both >= 0.9 * found


def test_training_looks_round_the_first_main_block():
    page = [H.Block(("html", "body", "nav"), f"m{k}", 2) for k in range(400)] + [H.Block(("html", "body", "article", "p"), "Text here.", 0)] * 300
    got = H.window(page)
    assert len(got) == H.TRAIN_BLOCKS and sum(H.told(b.path) for b in got) == H.TRAIN_BLOCKS // 2
    assert H.window(page[395:410]) == page[395:410]
    assert H.train_on([page[:400]]) is None


def test_without_a_model_texts_are_empty(spark):
    pages = spark.createDataFrame([(1, "u", "<div>words</div>")], "page_id long, url string, html string")
    assert H.train(pages) is None
    assert [r.text for r in H.extract(pages, H.train(pages)).collect()] == [""]
