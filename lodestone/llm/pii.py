"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
schemes and identifier cues. From each anchor a small parser expands to both
sides and validates what it finds. Emails, addresses of hosts, card and phone
numbers are the base kinds; personal addresses on the web (a user name in the
address or a home folder) and identifiers that follow a cue are added.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "url", "account"]
SCHEMES = ["http://", "https://", "ftp://", "sftp://", "ssh://"]
CUES = ["account", "acct", "iban", "passport", "ssn", "social security", "customer id", "user id", "member id", "tax id", "licence no", "license no",
        "konto", "kontonummer", "steuernummer", "ausweis", "compte", "cuenta", "passeport", "pasaporte"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUNS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]*")
_URL = re.compile(r"(?:([^\s/@:]+)(?::[^\s/@]*)?@)?([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)(?::[0-9]+)?(/[^\s\"'<>|]*)?")
_HOME = re.compile(r"/(?:~|users?/|u/|profiles?/|in/)[A-Za-z0-9._-]+", re.IGNORECASE)
_AFTER_CUE = re.compile(r"(?:\s*(?:number|nummer|num\.|no\.|nr\.|nr|#))?\s*(?:is|ist|est|es)?\s*[:=#]?\s*", re.IGNORECASE)
_IDENTIFIER = re.compile(r"[A-Za-z0-9](?:[ -]?[A-Za-z0-9])*")
_DIGIT = frozenset("0123456789")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for c in "@+0123456789":
        out.add_word(c, ("digit" if c in _DIGIT else c, 1))
    for s in SCHEMES:
        for x in {s, s.upper(), s.capitalize()}:
            out.add_word(x, ("scheme", len(x)))
    for c in CUES:
        for x in {c, c.upper(), c.capitalize(), c.title()}:
            out.add_word(x, ("cue", len(x)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _email(text: str, at: int, done: int) -> tuple[int, int] | None:
    """Expands the at-sign to both sides; the part before it starts no earlier than ``done``."""
    start = at
    while start > done and text[start - 1] in _LOCAL:
        start -= 1
    m = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, m.end()) if m else None


def _hosts(text: str, start: int, end: int):
    """Groups of four numbers in a chain of numbers and dots, from the left."""
    at = [start]
    for k in range(start, end):
        if text[k] == ".":
            at.append(k + 1)
    at.append(end + 1)
    for k in range(0, len(at) - 4, 4):
        if all(n.lstrip("0") == "" or (len(n.lstrip("0")) <= 3 and int(n) <= 255) for n in text[at[k]:at[k + 4] - 1].split(".")):
            yield at[k], at[k + 4] - 1


def _phone(text: str, at: int) -> tuple[int, int, int] | None:
    """Start, end and number of digits: up to the last digit of the run, with something between it and the first."""
    m = _PHONE.match(text, at)
    if not m:
        return None
    end = m.end()
    while end - at > 3 and text[end - 1] not in _DIGIT:
        end -= 1
    if end - at <= 3:
        return None
    return at, end, sum(c in _DIGIT for c in text[at:end])


def _iban(s: str) -> bool:
    return len(s) >= 15 and s[:2].isalpha() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _account(text: str, end: int) -> tuple[int, int] | None:
    """The identifier after a cue: 6 to 34 letters and digits with at least five digits, or a valid IBAN."""
    at = _AFTER_CUE.match(text, end).end()
    m = _IDENTIFIER.match(text, at, min(len(text), at + 64))
    if not m or at == end:
        return None
    if _iban(s := m.group().replace(" ", "").replace("-", "").upper()[:34]) and s.isascii():
        return m.start(), m.end()
    stop = m.start()
    for word in re.finditer(r"[A-Za-z0-9-]+", text[m.start():m.end()]):  # words without digits are prose
        if not _DIGIT & set(word.group()):
            break
        stop = m.start() + word.end()
    s = text[m.start():stop].replace(" ", "").replace("-", "")
    return (m.start(), stop) if 6 <= len(s) <= 34 and sum(c in _DIGIT for c in s) >= 5 else None


def spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, in order of start, then kind as listed."""
    out, done = [], dict.fromkeys(KINDS, 0)
    chain = digits = 0
    for last, (anchor, n) in _automaton().iter(text):
        start = last - n + 1
        if anchor == "digit":
            if start >= chain:
                chain = _RUNS.match(text, start).end()
                out += [(s, "ip", e) for s, e in _hosts(text, start, chain)]
            if start >= digits:
                digits = _DIGITS.match(text, start).end()
                number = text[start:digits].replace(" ", "").replace("-", "")
                if 14 <= len(number) <= 19 and luhn(number):
                    out.append((start, "card", digits))
        elif anchor == "@":
            if start >= done["email"] and (m := _email(text, start, done["email"])):
                out.append((m[0], "email", m[1]))
                done["email"] = m[1]
        elif anchor == "+":
            if m := _phone(text, start):
                if 10 <= m[2] <= 15:
                    out.append((start, "phone", m[1]))
        elif anchor == "scheme":
            m = _URL.match(text, last + 1)
            if start >= done["url"] and m and (m[1] or _HOME.match(m[3] or "")):
                end = m.end() - len(m.group()) + len(m.group().rstrip(".,;:!?)"))
                out.append((start, "url", end))
                done["url"] = end
        elif start >= done["account"] and not text[start - 1:start].isalnum() and not text[last + 1:last + 2].isalpha() and (m := _account(text, last + 1)):
            out.append((m[0], "account", m[1]))
            done["account"] = m[1]
    out.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    return out


_FIND = "array<struct<kind:string,start:long,end:long>>"


def find(docs: DataFrame, text_col: str = "text", into: str = "pii") -> DataFrame:
    """All rows and columns of ``docs`` with the spans of each text in ``into``, an array of (kind, start, end).

    Spans are in code points, end exclusive, in order of start and kind. A null
    or empty text has none. Rows are taken by themselves; an empty table gives
    an empty table; a column of ``docs`` named as ``into`` is replaced.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    docs = docs.select(*(c for c in docs.columns if c.lower() != into.lower()))
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, k, e in spans(t.as_py() or "")] for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, into])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{columns}, `{into}` {_FIND}")


def redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one names the whole."""
    step = F.aggregate(
        found, F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.array(
            F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"), s["end"].alias("at")))
        .otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))))
    tail = F.substring(text, step["at"].cast("int") + 1, F.length(text))
    return F.when(F.size(found) > 0, F.concat(F.array_join(step["out"], ""), tail)).otherwise(text)
