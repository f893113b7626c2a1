"""Byte-pair encoding by backtracking over longest matches, decoding by an offset table.

An Aho-Corasick automaton finds all tokens in a word. The encoder takes the
longest token at each place that is compatible with the token before it, and
steps back where none is. Two tokens are compatible if merging their symbols
side by side never joins across the border; a sequence of valid tokens whose
neighbours are all compatible is exactly what merging by rank gives. A place
that failed once is never tried again, so the work is linear in the word.
Compatibilities are kept in a table as they are met.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.packing import byte_of_char

VOCABULARY = "word_bpe_49k.json"
#: Words whose encodings a task keeps; it starts afresh beyond.
WORDS_KEPT = 400_000
PAIRS_KEPT = 2_000_000
#: The last byte of a word is a symbol of its own.
WORD_END = 0x100
INF = 1 << 60
#: In texts of these characters lower-casing a character never depends on its neighbours and nothing composes.
_PLAIN = re.compile(r"[\x00-ɏ]*\Z")


class WordBpe:
    """Encoder and decoder of one vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, back = spec["model"], byte_of_char()
        suffix = model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.tokenizer = Tokenizer.from_file(path)
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))

        def symbols(t: str) -> str:
            ends = t.endswith(suffix)
            b = [back[c] for c in (t[:-len(suffix)] if ends else t)]
            return "".join(map(chr, b[:-1])) + chr(b[-1] + WORD_END * ends)

        ids = {symbols(t): i for t, i in model["vocab"].items() if t not in self.added}
        self.rank, self.parts = {}, {}
        for r, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
            a, b = ids[symbols(a)], ids[symbols(b)]
            self.rank[a, b] = r
            whole = ids.get(self._join(model["merges"][r], symbols))
            if whole is not None:
                self.parts.setdefault(whole, (a, b, r))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for s, i in ids.items():
            if self._valid(i):
                self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.known: dict[str, tuple[int, str, str]] = {}
        names = {i: t for t, i in [*model["vocab"].items(), *self.added.items()]}
        raw = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).tolist()
        self.bytes = b"".join(raw)

    @staticmethod
    def _join(merge, symbols) -> str:
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        return symbols(a + b)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols at one edge of a token while it is merged: (symbol, rank of the merge that ends it)."""
        out, until = [], INF
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out[::-1]
            until = self.parts[token][2]
            token = self.parts[token][side]

    def _free(self, a: int, b: int, own: int = INF) -> bool:
        """Whether merging the symbols of a and b side by side never joins across the border before the merge of rank ``own``."""
        left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        while True:
            (x, rx), (y, ry) = left[i], right[j]
            r = self.rank.get((x, y), INF)
            if r < rx and r <= ry and r < own:  # of equal merges the leftmost is first
                return False
            if rx == ry == INF:
                return True
            if rx <= ry:
                i += 1
            else:
                j += 1

    def _valid(self, token: int) -> bool:
        """Whether merging a token's own symbols gives this token."""
        if token not in self.parts:
            return True
        a, b, r = self.parts[token]
        return self._free(a, b, r)

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[a, b] = self._free(a, b)
        return known

    def encode_symbols(self, s: str) -> list[int]:
        at: list[list[tuple[int, int]]] = [[] for _ in s]
        for end, found in self.automaton.iter(s):  # by rising end, so each list is by rising length
            at[end + 1 - found[0]].append(found)
        tokens, places, dead, pos, last, size = [], [], set(), 0, None, len(s)
        known = self.pairs.get
        while pos < size:
            found = at[pos]  # tokens that are tried leave the list; a place is entered once
            while found:
                n, i = found.pop()
                if pos + n in dead:
                    continue
                if last is not None:
                    fits = known((last, i))
                    if not (self.compatible(last, i) if fits is None else fits):
                        continue
                tokens.append(i)
                places.append(pos)
                pos, last = pos + n, i
                break
            else:
                dead.add(pos)
                if not tokens:
                    raise ValueError("a symbol is not in the vocabulary")
                tokens.pop()
                pos, last = places.pop(), tokens[-1] if tokens else None
        return tokens

    def decode(self, ids: list[int]) -> str:
        """Tokens as written in the vocabulary, a space between."""
        return b" ".join(self.bytes[self.offsets[i]:self.offsets[i + 1]] for i in ids).decode()

    def _word(self, word: bytes) -> tuple[int, str, str]:
        s = word.decode("latin-1")
        ids = self.encode_symbols(s[:-1] + chr(ord(s[-1]) + WORD_END))
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def _words(self, text: str):
        """The words of a text without added tokens; in rare scripts the tokenizer's own normaliser and splitter decide."""
        if _PLAIN.match(text):
            return self.words.findall(text.lower())
        back = byte_of_char()
        text = self.tokenizer.normalizer.normalize_str(text)
        return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def whole(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by a space, decoded text."""
        n, ids, out, known = 0, [], [], self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        parts = self.special.split(text) if self.special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                n, _ = n + 1, ids.append(str(self.added[part]))
                out.append(part)
                continue
            for w in self._words(part):
                got = known.get(w)
                if got is None:
                    got = known[w] = self._word(w.encode("utf-8", "surrogateescape"))
                n += got[0]
                ids.append(got[1])
                out.append(got[2])
        return n, " ".join(ids), " ".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row; ``full`` adds ``ids`` and ``decoded``.

    The ids are those of the tokenizers library for the file at ``path``
    without special tokens added; strings of added tokens in a text become
    those tokens. A null text is empty and has no ids. Every row is taken by
    itself, so repeated ids and texts give repeated rows; an empty table gives
    an empty table. Other columns are not read.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * full

    def run(batches):
        bpe = load(path)
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                n, ids, out = bpe.whole(t.as_py() or "")
                row = (i, n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(out.encode()).hexdigest())
                rows.append(row + (([int(x) for x in ids.split()], out) if full else ()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)

    kinds = ["long", "long", "string", "string", "array<long>", "string"]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
