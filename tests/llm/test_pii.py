import re

import pytest
from hypothesis import given, settings, strategies as st

from lodestone.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute(t):
    out = [(m.start(), "email", m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), "ip", m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), "card", m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], P.KINDS.index(s[1])))


def base(t):
    return [s for s in P.spans(t) if s[1] in P.KINDS[:4]]


TEXTS = ["", "a@b.c", "x.y+z%@mail.example.com.", "a@b@c.de@f.gh", "@b.c a@ a@b a@b. a@.c", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1 1.1.1.0300 000.0.0.1", "1.2.3 .4.5.6.7",
         "4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111  1111", "+1 (555) 010-9999", "+1555", "+1-5", "+12", "+1 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5", "++1 555 010 99990 ()-. x", "+1\n2",
         "é@b.co １２３@x.y", "a@b.c-d_e", "9" * 5000, "1." * 3000, "a" * 5000 + "@" + "b." * 2000 + "c", "+1 23+4 567 890 123 4", "192.168.0.1@host.example"]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    assert base(text) == brute(text)


@settings(max_examples=600, deadline=None)
@given(st.text("0125+-. ()@ab%é\n", max_size=60))
def test_random_texts(text):
    assert base(text) == brute(text)


def test_added_kinds():
    t = "See https://jane:pw@host.example/x, http://uni.example/~jane. IBAN: DE89 3704 0044 0532 0130 00; account no. 1234567-89 and https://www.example.org/licenses/ and accounting 1234567"
    got = [(k, t[s:e]) for s, k, e in P.spans(t) if k in ("url", "account")]
    assert got == [("url", "https://jane:pw@host.example/x"), ("url", "http://uni.example/~jane"), ("account", "DE89 3704 0044 0532 0130 00"), ("account", "1234567-89")]
    assert P.spans("account for the year, version 2.0, the passport of 3 people, 12 monkeys") == []


def test_find_redact_and_odd_rows(spark):
    rows = [(1, "mail a@b.co now +1 555 010 9999!", "p"), (2, None, "q"), (2, "", None), (None, "é 1.2.3.4.", "r")]
    df = P.find(spark.createDataFrame(rows, "doc_id long, text string, pii string"))
    got = [(r.doc_id, r.t) for r in df.select("doc_id", P.redacted(df.text, df.pii).alias("t")).collect()]
    assert got == [(1, "mail [EMAIL] now [PHONE]!"), (2, None), (2, ""), (None, "é [IP].")]
    assert P.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, data):
    import hashlib

    from lodestone.llm.queries import op5_pii
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    n = 0
    for r in op5_pii(spark, data).collect():
        want = brute(texts[r.doc_id])
        n += len(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in want) for k in P.KINDS[:4]]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in want).encode()).hexdigest()
    assert n > 0
