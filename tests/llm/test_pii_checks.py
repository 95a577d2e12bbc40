"""Check digits, context, spans against plain loops, and time on texts full of identifiers."""

import ipaddress
import random
import time

import pytest

from corvane.llm import pii

PLAIN = ["ISBN 978 0 306 40615 7", "4111 1111 1111 1112", "pages 1200-1250 1999", "timestamp 1700000000", "std::vector a::b 12:30:45", "DE89 3704 0044 0532 0130 01", "x 9807915762804490 y", "::", "1.2.3.4.5"]


@pytest.mark.parametrize("text", PLAIN)
def test_numbers_that_only_look_personal_stay(text):
    assert pii.find(text) == []


PLANTED = [
    ("fe80::1ff:fe23:4567:890a", "IP"), ("2001:db8:85a3:0:0:8a2e:370:7334", "IP"), ("10.0.0.1", "IP"), ("4845 1681 1440 7329", "CARD"), ("4845168114407329", "CARD"), ("378282246310005", "CARD"),
    ("GB82 WEST 1234 5698 7654 32", "IBAN"), ("555-123-4567", "PHONE"), ("+49 30 1234567", "PHONE"), ("ann@mail.example.org", "EMAIL"), ("219-09-9999", "SSN"), ("secret: hunter2hunter2", "SECRET"),
]


def test_planted_identifiers_are_all_that_is_found():
    rnd = random.Random(11)
    for _ in range(300):
        out, want = [], []
        for _ in range(rnd.randrange(1, 12)):
            out.append(rnd.choice(("garden,", "wall.", "é", "2024", "12", "a-b", "the")))
            if rnd.random() < 0.5:
                source, kind = rnd.choice(PLANTED)
                at = len(" ".join(out)) + 1
                shift = len("secret: ") if kind == "SECRET" else 0
                want.append((kind, at + shift, at + len(source)))
                out += [source, "and"]
        text = " ".join(out)
        assert [(k, a, b) for k, a, b, _ in pii.find(text)] == want


def slow_find(text):
    """All detectors, each match compared with all that were taken."""
    t = pii.Traced(text)
    for step in pii.CASCADE:
        t = step(t)
    taken = []
    for kind, spans, needs in pii.DETECTORS:
        for a, b in spans(t.text):
            x, y = t.source(a, b)
            if needs and text[x:y] == t.text[a:b] and not pii._CONTEXT.search(t.text, max(0, a - pii.CONTEXT_REACH), a):
                continue
            if all(y <= p or q <= x for p, q, _, _ in taken):
                taken.append((x, y, kind, t.text[a:b]))
    return [(k, x, y, p) for x, y, k, p in sorted(taken)]


def test_overlaps_against_all_pairs():
    rnd = random.Random(12)
    parts = [s for s, _ in PLANTED] + ["+1", "555", "4111 1111 1111 1111", "five five one", "call", "@", "token=", "a0" * 20, "-", " ", " ", "."]
    for _ in range(600):
        text = "".join(rnd.choice(parts) + rnd.choice(("", " ", "-")) for _ in range(rnd.randrange(1, 14)))
        found = pii.find(text)
        assert found == slow_find(text) and all(a[2] <= b[1] for a, b in zip(found, found[1:]))


def test_cards_against_every_window():
    rnd = random.Random(13)
    for _ in range(300):
        groups = ["".join(rnd.choice("0123456789") for _ in range(rnd.choice((3, 4, 4, 4, 16)))) for _ in range(rnd.randrange(1, 9))]
        if rnd.random() < 0.5:
            groups[rnd.randrange(len(groups))] = rnd.choice(("4845168114407329", "378282246310005"))
        want, i = [], 0
        while i < len(groups):
            ends = [j for j in range(i, len(groups)) if pii.is_card("".join(groups[i : j + 1]))]
            if ends:
                want.append(" ".join(groups[i : ends[-1] + 1]))
                i = ends[-1]
            i += 1
        text = " ".join(groups)
        assert [text[a:b] for a, b in pii.cards(text)] == want


def test_luhn_and_remainders():
    assert pii.luhn("79927398713") and not any(pii.luhn(f"7992739871{d}") for d in "012456789")
    assert pii.is_iban("DE89 3704 0044 0532 0130 00") and not pii.is_iban("DE88 3704 0044 0532 0130 00")
    assert pii.is_ipv6(str(ipaddress.ip_address("2001:db8::1"))) and not pii.is_ipv6("1:2:3")


def test_many_identifiers_take_linear_time():
    took = []
    for n in (4_000, 16_000):
        text = " ".join(f"a{i}@mail.example.com" for i in range(n))
        began = time.process_time()
        assert len(pii.find(text)) == n
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]


def test_redacted_rows(spark):
    rows = [(1, None, 3), (2, "", 0), (3, "mail ann@mail.example.org", 25), (3, "mail ann@mail.example.org", 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, pii.redact_documents(docs).collect()))
    assert got == [(1, None, None), (2, "", 0), (3, "mail <EMAIL>", 12), (3, "mail <EMAIL>", 12)]
    assert pii.redact_documents(docs.limit(0)).collect() == []
