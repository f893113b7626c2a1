import pytest

from lodestone.llm import line_dedup as L

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=10):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k, i2 = key(line), 2**63 - 1 if i is None else i
            first[k] = min(first.get(k, i2), i2)
    out = []
    for i, t in rows:
        lines, i2 = (t or "").split("\n"), 2**63 - 1 if i is None else i
        kept = [x for x in lines if len(key(x)) < min_chars or first[key(x)] == i2]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def rows():
    base = ["A line that repeats often", "short", "", "  a LINE that repeats often\t", "Éclair au chocolat noir", "éclair au chocolat noir", "x" * 3000, "tail\r", "\x0bpadded line here\x0c"]
    out = [(k, "\n".join(base[(k * j + j) % len(base)] + ("" if j % 3 else f" {k // 3}") for j in range(k % 9))) for k in range(40)]
    out += [(50, None), (51, ""), (52, "\n\n"), (None, "A line that repeats often\nonly here is this one"), (None, "only here is this one"), (60, "A line that repeats often\nx"), (60, "x\nA line that repeats often"),
            (5, "A line that repeats often"), (61, "unique to this id twice\nunique to this id twice"), (62, "new one in two rows"), (62, "new one in two rows"), (70, "\n".join(f"line number {k} of many" for k in range(3000)))]
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_against_brute_force(spark, batches, fanout):
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows()], "doc_id long, text string, n_lines int, _id string")
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in L.dedup_lines(df, batches=batches, fanout=fanout).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows())))


def test_empty(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_stay_disjoint_and_few(spark):
    runs = L.LevelledRuns(spark, 2)
    for k in range(5):
        runs.add(spark.range(k * 10, k * 10 + 10).selectExpr("id as _h1", "id as _h2"))
    assert [len(x) for x in runs.levels] == [1, 0, 1] and runs.all().count() == 50
