"""Spans against the plain patterns and checks of the base kinds."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm.pii import detected, find, luhn, masked, mod97, scrubbed, span_digests

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0])]


def base(text):
    return [(s.kind, s.start, s.end) for s in find(text) if s.base]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="0123456789.@+- ()ab%_é", max_size=60))
def test_base_spans_equal_plain_patterns(text):
    assert base(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "a.b@c.de", "a@b@c.d", "+1 (555) 010-4477", "1.2.3.4.5.6.7.8", "300.1.1.1", "é", " ", "-", "card ", "0"]), max_size=12).map("".join))
def test_base_spans_of_likely_texts(text):
    assert base(text) == plain(text)


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000, "1.2" * 100_000, "+1" + " " * 300_000, "a@" * 100_000, "DE" + "A1 " * 100_000, "+" * 300_000])
def test_long_runs_take_linear_time(text):
    find(text)


def test_checksums_and_context():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("DE89370400440532013000") and not mod97("DE88370400440532013000")
    kinds = lambda t: [s.kind for s in find(t)]
    assert kinds("my IBAN is DE89 3704 0044 0532 0130 00 AND MORE") == ["iban"]
    assert kinds("pay GB82WEST12345698765432.") == ["iban"]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00") == []
    assert kinds("my amex card 378282246310005") == ["card"] and kinds("order 378282246310005") == []
    assert kinds("phone: 555-867-5309") == ["phone"] and kinds("order number 555-867-5309") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert masked("x a.b@c.de y") == "x <EMAIL> y" and masked(None) is None and masked("") == ""


def test_tables(docs):
    rows = docs.select("doc_id", "text").collect()
    got = span_digests(detected(docs)).collect()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in plain(r["text"] or "")).encode()).hexdigest()) for r in rows)
    assert sorted((g["doc_id"] is None, g["doc_id"] or 0, g["base_sha256"]) for g in got) == want
    assert detected(docs.limit(0)).collect() == []
    clean = scrubbed(docs)
    assert clean.schema == docs.schema and clean.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[3] == "mail <EMAIL> or call <PHONE> now" and texts[7] is None and texts[5] == ""


# DuckDB marks each match, and the lengths of the parts between marks give its place.
BASE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS (SELECT unnest([1, 2, 3, 4]) AS n, unnest(['email', 'ip', 'card', 'phone']) AS kind),
s AS (SELECT doc_id, n, kind, string_split(CASE n
    WHEN 1 THEN regexp_replace(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', chr(1) || '\1' || chr(1), 'g')
    WHEN 2 THEN regexp_replace(text, '([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)', chr(1) || '\1' || chr(1), 'g')
    WHEN 3 THEN regexp_replace(text, '([0-9](?:[\x20-]?[0-9])+)', chr(1) || '\1' || chr(1), 'g')
    ELSE regexp_replace(text, '(\+[0-9][\x20().0-9-]+[0-9])', chr(1) || '\1' || chr(1), 'g') END, chr(1)) AS parts FROM d, k),
p AS (SELECT doc_id, n, kind, i, parts[i] AS match, list_sum(list_transform(parts[1:i - 1], lambda x: length(x)))::BIGINT AS start FROM (SELECT *, unnest(range(2, len(parts), 2)) AS i FROM s)),
g AS (SELECT *, regexp_replace(match, '[^0-9]', '', 'g') AS digits FROM p),
v AS (SELECT * FROM g WHERE n = 1
    OR n = 2 AND list_max(list_transform(string_split(match, '.'), lambda x: x::HUGEINT)) <= 255
    OR n = 3 AND length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length(digits)), lambda j: CASE WHEN j % 2 = 0 THEN substr(digits, length(digits) - j, 1)::INT
        ELSE substr(digits, length(digits) - j, 1)::INT * 2 - CASE WHEN substr(digits, length(digits) - j, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    OR n = 4 AND length(digits) BETWEEN 8 AND 15)
SELECT d.doc_id, count(*) FILTER (kind = 'email'), count(*) FILTER (kind = 'ip'), count(*) FILTER (kind = 'card'), count(*) FILTER (kind = 'phone'),
    sha256(coalesce(string_agg(kind || ':' || start || ':' || (start + length(match)), ',' ORDER BY n, start), '')) FROM d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id
"""


def test_base_spans_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    got = span_digests(detected(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))).drop("spans").collect()
    assert sum(r["n_card"] for r in got) and sorted(map(tuple, got)) == sorted(con.execute(BASE).fetchall())
