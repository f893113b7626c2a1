"""Quality rules as a short-circuit cascade.

Each rule rejects or lets pass. On a bounded sample every rule is timed and its
share of rejections counted; the cascade then asks the rules in the order of
rejections per unit of cost and stops at the first that rejects. The order
changes the time only: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from functools import cached_property
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Length up to which the distinct words asked for grow in proportion.
VOCABULARY_WORDS = 2000
#: Documents on which the rules are timed; the order of the rules is all that depends on it.
SAMPLE_ROWS = 1000
_BLANK = " \t\n\x0b\x0c\r"


class Features:
    """What the rules ask of a text, computed when first asked."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _BLANK))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(_BLANK)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(*(w[k:] for k in range(WINDOW))))
        if len(set(windows)) == len(windows):
            return 0
        count, covered, end = Counter(windows), 0, 0
        for k, x in enumerate(windows):
            if count[x] > 1:
                covered += k + WINDOW - max(k, end)
                end = k + WINDOW
        return covered

    @cached_property
    def n_marks(self) -> int:
        return self.text.count("!") + self.text.count("?")

    @cached_property
    def n_upper(self) -> int:
        return sum(map(self.text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    @cached_property
    def n_lower(self) -> int:
        return sum(map(self.text.count, "abcdefghijklmnopqrstuvwxyz"))

    @cached_property
    def n_stutter(self) -> int:
        """Words equal to the word before."""
        return sum(map(eq, self.words, self.words[1:]))

    @cached_property
    def n_distinct(self) -> int:
        return len(set(self.words))


def few_words(f: Features) -> bool:
    return f.n_words < MIN_WORDS


def repeated_windows(f: Features) -> bool:
    return 100 * f.n_repeat_words > MAX_REPEATED_PERCENT * f.n_words


def few_distinct_words(f: Features) -> bool:
    """Distinct words below a twentieth of all up to ``VOCABULARY_WORDS``; beyond, what is asked for grows with the square root of the length, as the vocabulary of prose does."""
    return (20 * f.n_distinct) ** 2 < f.n_words * min(f.n_words, VOCABULARY_WORDS)


#: What a document must pass in any case.
BASE: dict[str, Callable[[Features], bool]] = {"few_words": few_words, "repeated_windows": repeated_windows}
#: What the method adds; each is true if the document is to be rejected.
RULES: dict[str, Callable[[Features], bool]] = {
    "symbols": lambda f: 10 * f.n_symbols > f.n_words,
    "short_or_long_words": lambda f: f.word_chars < 2 * f.n_words or f.word_chars > 15 * f.n_words,
    "marks": lambda f: 4 * f.n_marks > f.n_words,
    "shouting": lambda f: f.n_upper > f.n_lower,
    "duplicate_lines": lambda f: 2 * f.n_dup_lines > len(f.lines),
    "stutter": lambda f: 10 * f.n_stutter > 3 * f.n_words,
    "few_distinct_words": few_distinct_words,
}


def order_rules(docs: DataFrame, text_col: str = "text", rules: dict[str, Callable[[Features], bool]] | None = None, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejections per nanosecond on at most ``sample_rows`` documents, the most first; ties by name."""
    rules = rules or RULES

    def run(batches):
        cost, hits, n = dict.fromkeys(rules, 0), dict.fromkeys(rules, 0), 0
        for b in batches:
            for t in b.column(0):
                text, n = t.as_py() or "", n + 1
                for name, rule in rules.items():
                    began = time.perf_counter_ns()
                    hits[name] += rule(Features(text))
                    cost[name] += time.perf_counter_ns() - began
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(list(rules)), pa.array(list(cost.values())), pa.array(list(hits.values()))], names=["rule", "cost", "hits"])

    n = docs.count()
    sample = docs.select(text_col).sample(min(1.0, 1.2 * sample_rows / max(n, 1)), seed=1).limit(sample_rows)
    seen = {r.rule: r for r in sample.mapInArrow(run, "rule string, cost long, hits long").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("hits").alias("hits")).collect()}
    return sorted(rules, key=lambda r: (-(seen[r].hits / max(1, seen[r].cost)) if r in seen else 0.0, r))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Callable[[Features], bool]] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row.

    A null or empty text has no words and fails. Rows are judged by themselves,
    so repeated ids and texts give repeated rows; an empty table gives an empty
    table. Other columns are not read.
    """
    rules = rules or RULES
    cascade = [rules[r] for r in order_rules(docs, text_col, rules, sample_rows)]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = ["doc_id", *counts, "base_failed", "kept"]

    def run(batches):
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                f = Features(t.as_py() or "")
                failed = any(rule(f) for rule in BASE.values())
                out.append((i, *(getattr(f, c) for c in counts), failed, not failed and not any(rule(f) for rule in cascade)))
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean")


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(words[s:s + 7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS s FROM w WHERE len(words) >= 8)),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(s, s + 8)) AS p FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1)
  GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(text) - length(translate(text, '!?', '')) AS marks, length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS upper,
         length(text) - length(translate(text, 'abcdefghijklmnopqrstuvwxyz', '')) AS lower, len(list_distinct(words)) AS n_distinct,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS stutter
  FROM w LEFT JOIN repeated ON repeated.doc_id = w.doc_id LEFT JOIN lines ON lines.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 4 * marks > n_words
            OR 10 * stutter > 3 * n_words OR upper > lower OR 2 * n_dup_lines > n_lines OR 400 * n_distinct * n_distinct < n_words * least(n_words, 2000)) AS kept
FROM b
"""
