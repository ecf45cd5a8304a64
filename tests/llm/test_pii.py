"""Personal data: base spans against plain regular expressions, added kinds by example, masking, and unusual texts."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clusterlens.llm import pii, queries

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def checksum(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
    return sum(n // 10 + n % 10 for n in doubled) % 10 == 0


def brute(text):
    """Base spans by the plain patterns."""
    found = []
    for name, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match[0])
            passes = {
                "email": True,
                "ip": all(int(part) <= 255 for part in match[0].split(".")) if name == "ip" else False,
                "card": 13 <= len(digits) <= 19 and checksum(digits),
                "phone": 9 <= len(digits) <= 15,
            }
            if passes[name]:
                found.append((name, *match.span()))
    return found


def base(text):
    return [span[:3] for span in pii.spans_of(text) if span[4]]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab1290.@-+_ ()%é\n", max_size=60))
def test_base_spans_of_random_texts(text):
    assert base(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "300.1.2.3.4", "+1 (499) 555-6503", "a.b@c.d", "@", "x@y", " ", ".", "-", "é", "7", "+"]), max_size=14))
def test_base_spans_of_joined_pieces(parts):
    text = "".join(parts)
    assert base(text) == brute(text)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("IBAN DE89 3704 0044 0532 0130 00 AND", [("iban", "DE89 3704 0044 0532 0130 00")]),
        ("GB82WEST12345698765432", [("iban", "GB82WEST12345698765432")]),
        ("BE68 5390 0754 7034 THE", [("iban", "BE68 5390 0754 7034")]),
        ("DE88 3704 0044 0532 0130 00", []),
        ("my SSN is 123-45-6789.", [("ssn", "123-45-6789")]),
        ("part 123-45-6789.", []),
        ("SSN 666-45-6789, 000-11-2222, 912-11-2222, 123-00-4444, 123-45-0000", []),
        ("call me: (499) 555-6503 today", [("local_phone", "(499) 555-6503")]),
        ("sum 499 555 6503 today", []),
        ("7536784127813051 4111111111111111", [("card_in_chain", "4111111111111111")]),
        ("phone +1 (499) 555-6503", [("phone", "+1 (499) 555-6503")]),
        ("Telefon: 030 1234 567", [("local_phone", "030 1234 567")]),
    ],
)
def test_added_kinds(text, found):
    spans = pii.spans_of(text)
    assert [(kind, text[a:b]) for kind, a, b, _, _ in spans] == found
    assert all(0.5 <= score <= 1 for _, _, _, score, _ in spans)


def test_words_near_by_adjust_the_score():
    plain, near = pii.spans_of("a b@c.de"), pii.spans_of("mail: b@c.de")
    assert plain[0][3] < near[0][3] <= 1
    far = "SSN" + " " * pii.WORDS_BEFORE + "123-45-6789"
    assert pii.spans_of(far) == [] and pii.spans_of("123-45-6789 (SSN)")
    assert pii.spans_of("123-45-6789", threshold=0.3)


def test_added_spans_meet_no_other():
    text = "tel 1.2.3.4.5.6.7.8@mail.example.com +1 (499) 555-6503 tel 499 555 6503"
    spans = pii.spans_of(text)
    for kind, a, b, _, is_base in spans:
        assert is_base or not any(a < d and c < b for other, c, d, _, _ in spans if (other, c) != (kind, a))


def test_masking(spark):
    text = "to a@b.co or 1.2.3.4@x.yz"
    assert pii.masked(text) == "to [EMAIL] or [EMAIL]"
    assert pii.masked(None) is None and pii.masked("") == ""
    docs = spark.createDataFrame([(1, text, "s"), (2, None, None)], "doc_id long, text string, spans string")
    assert [tuple(r) for r in pii.mask(docs).collect()] == [(1, pii.masked(text), "s"), (2, None, None)]


@pytest.mark.parametrize("part", ["a", "1", "a@", "1.", "1 ", "+1", "a.b@c.", "AB12", "123-", "(12)", ".", "@", "1.2.3.4 ", "9" * 20 + " "])
def test_long_texts_take_linear_time(part):
    text = part * (400_000 // len(part))
    begun = time.monotonic()
    pii.spans_of(text)
    assert time.monotonic() - begun < 10


def test_the_query_and_unusual_rows(spark, tmp_path):
    rows = [
        (1, "mail a@b.co, 1.2.3.4", "x"), (2, None, None), (3, "", "y"), (None, "+1 (499) 555-6503", None),
        (1, "mail a@b.co, 1.2.3.4", "x"), (4, "é🙂 a@b.co", "z"), (5, "IBAN GB82WEST12345698765432", "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(map(tuple, queries.op11_pii(spark, str(tmp_path)).collect()), key=str)

    def expected(doc_id, text):
        spans = brute(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = [sum(s[0] == kind for s in spans) for kind in ("email", "ip", "card", "phone")]
        added = "iban:5:27" if "IBAN" in (text or "") else ""
        return doc_id, *counts, hashlib.sha256(listed.encode()).hexdigest(), ",".join(filter(None, [listed, added]))

    assert found == sorted((expected(d, t) for d, t, _ in rows), key=str)
    assert pii.find(docs.limit(0)).count() == 0


def test_the_query_against_plain_patterns(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    found = queries.op11_pii(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for row in found:
        spans = brute(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(
            sum(s[0] == kind for s in spans) for kind in ("email", "ip", "card", "phone")
        )
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(row.spans.split(","))
