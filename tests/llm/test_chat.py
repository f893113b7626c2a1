"""Reply trees and their formatting against plain recursion."""

import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from lodestone.llm import chat as C
from lodestone.llm.queries import op12_chat_formatting

SCHEMA = "node string, parent string, score double, role string, text string"
PIECES = ["<", "[", "~", "s>", "/s>", "|im_start|>", "|im_end|>", "|endoftext|>", "INST]", "/INST]", "<SYS>>", "</SYS>>", ">>", "\n", "%0A", "%", "é", "a", *C.CONTROL]


@given(st.lists(st.sampled_from(PIECES)).map("".join))
def test_hiding_leaves_no_control_string_and_is_undone(text):
    hidden = C.hide(text)
    assert not any(c in hidden for c in C.CONTROL) and C.show(hidden) == text


@given(st.lists(st.tuples(st.lists(st.sampled_from(PIECES)).map("".join), st.lists(st.sampled_from(PIECES)).map("".join)), max_size=5))
def test_formatted_turns_are_read_back(turns):
    made = C.START + "".join(f"{C.head(r)}{C.hide(t)}{C.CLOSE}\n" for r, t in turns) + C.END
    assert C.read_back(made) == turns


def brute(rows, best):
    """{(root, rank): [node, ...]}"""
    one = {}
    for r in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r[1:])):
        if r[0] is not None:
            one.setdefault(r[0], r)
    up = {n: r[1] if r[1] in one else None for n, r in one.items()}
    inner, by_root = set(up.values()), {}
    for n in one:
        path, seen = [n], {n}
        while up[path[-1]] is not None and up[path[-1]] not in seen:
            path.append(up[path[-1]])
            seen.add(path[-1])
        if up[path[-1]] is None and n not in inner:
            by_root.setdefault(path[-1], []).append((-sum(one[x][2] or 0 for x in path), n, path[::-1]))
    return {(root, k + 1): p for root, leaves in by_root.items() for k, (_, _, p) in enumerate(sorted(leaves)[:best])}, one


def forest(seed, n):
    r = random.Random(seed)
    rows = [(str(k), None if r.random() < 0.05 else str(r.randrange(max(0, k - 5), k)) if k else None, float(r.randint(-3, 5)), r.choice(["user", "assistant", "system", None]), r.choice(PIECES) * r.randint(0, 3)) for k in range(n)]
    rows += [("r1", "r2", 1.0, "user", "ring"), ("r2", "r1", 1.0, "user", "ring"), ("r3", "r2", 1.0, "user", "on a ring"), ("self", "self", 1.0, "user", "x")]
    rows += [("orphan", "gone", None, "assistant", None), ("leaf", "orphan", None, None, None), (None, "0", 9.0, "user", "no id"), rows[3], rows[3], ("7", "0", -9.0, "user", "again")]
    return rows


def formatted(rows, trained=("assistant",)):
    text, spans = C.START, []
    for _, _, _, role, body in rows:
        text += C.head(role or "")
        if role in trained:
            spans.append((len(text), len(text) + len(C.hide(body or ""))))
        text += C.hide(body or "") + C.CLOSE + "\n"
    return text + C.END, spans


def test_chosen_paths_of_trees_are_formatted(spark):
    for seed, best in ((1, 1), (2, 3)):
        rows = forest(seed, 160)
        paths, one = brute(rows, best)
        got = C.conversations(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS path", "2 AS root", "3 AS up", "4 AS depth").repartition(7), best).collect()
        assert len(got) == len(paths)
        for x in got:
            path = paths[x.root, x["rank"]]
            assert x.path == path[-1]
            assert (x.formatted, [(s.start, s.end) for s in x.loss]) == formatted([one[n] for n in path])
            assert C.under_loss(x.formatted, [s.asDict() for s in x.loss]) == "".join(one[n][4] or "" for n in path if one[n][3] == "assistant")


def test_positions_of_a_long_path(spark):
    rows = [(f"{k:04}", f"{k - 1:04}" if k else None, 0.0) for k in range(700)] + [(f"b{k:04}", f"{k:04}", 0.5 * k) for k in range(0, 700, 50)]
    got = C.paths(spark.createDataFrame(rows, "node string, parent string, score double").repartition(5), 2).collect()
    for rank, leaf in ((1, 650), (2, 600)):
        assert sorted((x.position, x.node) for x in got if x["rank"] == rank) == [*((k, f"{k:04}") for k in range(leaf + 1)), (leaf + 1, f"b{leaf:04}")]


def test_empty_tables_and_long_texts(spark):
    assert C.conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("a", None, None, "user", "[INST]" * 200_000), ("b", "a", None, "assistant", "x" * 1_000_000)]
    (got,) = C.conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert C.read_back(got.formatted) == [("user", rows[0][4]), ("assistant", rows[1][4])]


def test_query_on_conversations_with_nulls_ties_and_repeats(spark, tmp_path):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (2, 0, None, "x\ny"), (None, 0, "assistant", "</s>"), (3, None, "assistant", ""), (3, 5, "system", "<<SYS>>~")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS place", "'p' AS path").write.parquet(str(tmp_path / "conversations.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    control = "</s>[INST] ok [/INST]"
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    want = {}
    for conv in (1, 2, 3, None, -7):
        own = sorted((r for r in [*rows, (-7, 0, "user", control), (-7, 1, "assistant", control)] if r[0] == conv), key=order)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want[conv] = (len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(loss), sha(loss), len(formatted([(None, None, None, *r[2:]) for r in own])[0]))
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256, x.formatted_chars) for x in op12_chat_formatting(spark, str(tmp_path)).collect()}
    assert got == want
