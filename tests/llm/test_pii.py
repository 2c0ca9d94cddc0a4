import itertools
import time

import pytest

from folioscan.llm.identifiers import form_of
from folioscan.llm.pii import DATE, Pseudonyms, find, personal_values, redacted

KEY = b"test key"


def values(text):
    return {(k, text[a:b]) for a, b, k in find(text)}


CASES = [
    ("Write to jo.doe+x@mail.example.org, please.", {("email", "jo.doe+x@mail.example.org")}),
    ("Mail jo at mail.site dot test or jo(at)site(dot)example or JO [at] site.test.", {("email", "jo at mail.site dot test"), ("email", "jo(at)site(dot)example"), ("email", "JO [at] site.test")}),
    ("Message-ID: <2024.55@mx.site.test>\nget tool@2.27.0 first", set()),
    ("Look at the dot matrix at noon.", set()),
    ("call +49 30 23125 749 or (657) 555-0149 or 030/23125-641", {("phone", "+49 30 23125 749"), ("phone", "(657) 555-0149"), ("phone", "030/23125-641")}),
    ("or 020 7946 0121, 986.555.0140, 1-292-555-0173 ext. 220.", {("phone", "020 7946 0121"), ("phone", "986.555.0140"), ("phone", "1-292-555-0173 ext. 220")}),
    ("tel +33 1 99 00\n     76 56", {("phone", "+33 1 99 00\n     76 56")}),
    ("bug 483-39792, length 602983, 192.0.2.109, RFC 2934, 2029-05-17 12:44:10, Part no. 977-1107-23", set()),
    ("ssn 907-27-0712; QQ 12 34 56 A; QQ123456A; 02 437 320 370; 971907-975K; J55J02381.", {("id_number", x) for x in ("907-27-0712", "QQ 12 34 56 A", "QQ123456A", "02 437 320 370", "971907-975K", "J55J02381")}),
    ("to Flat 16, 9 Oak Road, Townham SU7 1PD.", {("address", "Flat 16, 9 Oak Road, Townham SU7 1PD")}),
    ("to 300 Elm St., Newville, ES 78944.", {("address", "300 Elm St., Newville, ES 78944")}),
    ("Lindenstraße 12a, 53967 Kliston. 204, rue du Pont, 83404 Ayville.", {("address", "Lindenstraße 12a, 53967 Kliston"), ("address", "204, rue du Pont, 83404 Ayville")}),
    ("Calle Sol 98, 2º B\n28375 Villar", {("address", "Calle Sol 98, 2º B\n28375 Villar")}),
    ("This page was written by Ana María\n     van Dorn (x).", {("name", "Ana María\n     van Dorn")}),
    ("Thanks to Dr. A. B. Roe for it. As Roe, Ann pointed out on the list", {("name", "A. B. Roe"), ("name", "Roe, Ann")}),
    ("checked by Jo Doe and Al ROE, tax id", {("name", "Jo Doe"), ("name", "Al ROE")}),
    ("Reported-by: Jo Doe Tested-by: x@y.test", {("name", "Jo Doe"), ("email", "x@y.test")}),
    (".An Jo Doe Aq Mt a@b.test", {("name", "Jo Doe"), ("email", "a@b.test")}),
    ("On Tue, Jo-Ann Doe wrote:\n> x", {("name", "Jo-Ann Doe")}),
    ("Laut Jo Doe fehlt. Selon Al Roe, le. Según Jo Roe, falta.", {("name", "Jo Doe"), ("name", "Al Roe"), ("name", "Jo Roe")}),
    ("-- \nRoe, Ann\n12 Oak Lane\nTownham, ES 78944\n", {("name", "Roe, Ann"), ("address", "12 Oak Lane\nTownham, ES 78944")}),
    ("The Zasepex Toolkit and Fozosel Formatter both read this file in May.", set()),
]


@pytest.mark.parametrize("text, want", CASES)
def test_values(text, want):
    assert values(text) == want


@pytest.mark.parametrize("number", ["+14155550123", "+49 30 1234567", "+49 (0)30 123456", "+49(0)30 1234567", "+1 2025550123", "(030) 1234567", "(212) 5550123", "212-555-0123"])
def test_other_ways_to_write_a_phone_number(number):
    assert values(f"Please call {number}, or write.") == {("phone", number)}


def test_mailboxes_without_a_letter_are_told_from_message_identifiers():
    assert values("Write to 123456789@qq.com, or to <tool@site.test>.") == {("email", "123456789@qq.com"), ("email", "tool@site.test")}
    assert values("To: <10001@qq.com>\n> Cc: x <10002@qq.com>") == {("email", "10001@qq.com"), ("email", "10002@qq.com")}
    assert ("email", "10003@qq.com") in values('I asked Jo Doe <10003@qq.com> about it')
    assert values("References: <1.2@mx.test>\n <2024.55@mx.test>\nsee <2024.56@mx.test>") == set()


@pytest.mark.parametrize("text", ["000-12-3456", "666-12-3456", "212-00-3456", "212-34-0000", "DE89 3704 0044 0532 0130 01", "4111 1111 1111 1112", "12345678A", "X1234567A"])
def test_numbers_that_are_not_valid(text):
    assert values(f"It is {text} here.") == set()


@pytest.mark.parametrize("text", ["212-34-5678", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "4111-1111-1111-1111", "12345678Z", "X1234567L", "2 55 08 14 168 025 38", "86095742719", "131052-308T"])
def test_valid_numbers_go_to_valid_ones(text):
    p = Pseudonyms(KEY)
    assert ("id_number", text) in values(f"It is {text} here.") and form_of(text) is not None
    new = p.number(text, "id_number")
    assert new != text and form_of(new) is form_of(text) and len(new) == len(text) and p.number(new, "id_number", back=True) == text


def test_invalid_numbers_stay_apart_from_valid_ones():
    p = Pseudonyms(KEY)
    every = [f"{a:03d}-{b:02d}-0012" for a in (0, 1, 212, 665, 666, 999) for b in range(100)]
    new = [p.number(v, "id_number") for v in every]
    assert len(set(new)) == len(every)
    assert all((form_of(v) is None) == (form_of(n) is None) and p.number(n, "id_number", back=True) == v for v, n in zip(every, new))


def test_one_number_written_in_many_ways_stays_linked():
    p = Pseudonyms(KEY)
    digits = lambda t: "".join(c for c in t if c.isdigit())
    for group in (["+1 555-123-4567", "+1 555 123 4567", "+1 (555) 123-4567", "+15551234567"], ["QQ 61 31 29 C", "QQ613129C"], ["212-34-5678", "212345678"]):
        kind = "phone" if group[0][0] == "+" else "id_number"
        new = {digits(p.number(v, kind)) for v in group}
        assert len(new) == 1 and new != {digits(group[0])}
    assert p.number("+1 555-123-4567", "phone").startswith("+1 ") and p.number("+49 30 1234567", "phone").startswith("+49 ")
    a, b = p.placeholder("name", "Jo Doe"), p.placeholder("name", "Jo Roe")
    assert a != b and len(a.split()[1]) == 33  # 128 bits and the bracket


def test_a_name_is_replaced_wherever_it_stands():
    out = Pseudonyms(KEY).redact("This page was written by Jo Dorn. The patch of Jo Dorn is here; Jo Dornier is another.")
    assert "Jo Dorn " not in out and "Jo Dornier" in out and out.count("[NAME ") == 2


def test_many_values_in_one_line():
    began = time.perf_counter()
    assert len(find("x " + " ".join(f"a{i}@mail.test" for i in range(20_000)))) == 20_000
    assert len(find(" ".join(f"Reported-by: Jo Dorn{'abcdefghij'[i % 10]}" for i in range(20_000)))) == 20_000
    assert time.perf_counter() - began < 20


def test_feistel_is_a_permutation():
    p = Pseudonyms(KEY)
    for base, length in ((10, 1), (10, 2), (10, 3), (26, 2)):
        every = [p.permute(v, base, length, "x") for v in range(base**length)]
        assert sorted(every) == list(range(base**length))
        assert [p.permute(v, base, length, "x", back=True) for v in every] == list(range(base**length))


def test_numbers_keep_their_format():
    p = Pseudonyms(KEY)
    for v in ("907-27-0712", "QQ 12 34 56 A", "+49 30 23125 749", "J55J02381"):
        new = p.number(v, "id_number")
        assert new != v and p.number(new, "id_number", back=True) == v
        assert all(a.isdigit() == b.isdigit() and a.isalpha() == b.isalpha() and (a == b or a.isalnum()) for a, b in zip(v, new)) and len(new) == len(v)
    assert Pseudonyms(b"other").number("907-27-0712", "id_number") != p.number("907-27-0712", "id_number")


def test_dates_stay_dates():
    p = Pseudonyms(KEY)
    import datetime as dt

    seen = set()
    for n in range(0, 73_000, 997):
        d = (dt.date(1900, 1, 1) + dt.timedelta(days=n)).isoformat()
        new = p.date(d)
        assert dt.date(1900, 1, 1) <= dt.date.fromisoformat(new) < dt.date(2100, 1, 1)
        seen.add(new)
    assert len(seen) == len(range(0, 73_000, 997))
    assert p.date("31.12.1999")[2] == "." and p.date("99.99.2024") != "99.99.2024"


def test_text_stays_readable_and_linked():
    p = Pseudonyms(KEY)
    a = p.redact("Dear Sir, call +49 30 23125 749 today. born 1980-02-29.")
    b = p.redact("Again: +49 30 23125 749!")
    assert a.startswith("Dear Sir, call [PHONE +") and a.endswith("].") and DATE.upper() in a
    assert a[a.index("[PHONE") : a.index("]") + 1] in b
    assert p.redact("nothing here") == "nothing here"
    for text, want in CASES:
        out = p.redact(text)
        assert all(v not in out for _, v in want)


def test_tables(spark):
    long = "word " * 200_000 + "Mail jo@site.test now and jo@site.test again"
    rows = [(1, long), (2, None), (3, ""), (None, "x@y.test"), (1, long)]
    df = spark.createDataFrame([(*r, "k", "v") for r in rows], "doc_id bigint, text string, kind string, value string")
    got = [tuple(r) for r in personal_values(df, "doc_id", "text").distinct().collect()]
    assert got == [(1, "email", "jo@site.test")]
    out = redacted(df, "doc_id", "text", KEY).collect()
    assert len(out) == 5 and {r.text for r in out if r.doc_id == 2} == {None} and {r.text for r in out if r.doc_id == 3} == {""}
    assert personal_values(df.filter("false"), "doc_id", "text").count() == 0


def test_values_never_overlap():
    for (t, _), (u, _) in itertools.product(CASES, CASES):
        spans = find(t + "\n\n" + u)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
