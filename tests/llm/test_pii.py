import random
import time

import pytest

from corvane.llm import pii

CASES = [
    ("mail john.doe [at] example (dot) com now", "EMAIL", "john.doe [at] example (dot) com", "john.doe@example.com"),
    ("ask jane dot roe at mail dot example dot com ok", "EMAIL", "jane dot roe at mail dot example dot com", "jane.roe@mail.example.com"),
    ("x jоhn@exаmple.com y", "EMAIL", "jоhn@exаmple.com", "john@example.com"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "EMAIL", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "john@example.com"),
    ("john@ex​ample.com", "EMAIL", "john@ex​ample.com", "john@example.com"),
    ("call five five five one two three four five six seven please", "NUMBER", "five five five one two three four five six seven", "5551234567"),
    ("dial five five five dash one two three dash four five six seven ok", "PHONE", "five five five dash one two three dash four five six seven", "555-123-4567"),
    ("host one nine two dot one six eight dot zero dot one up", "IP", "one nine two dot one six eight dot zero dot one", "192.168.0.1"),
    ("call +1 (524) 555-7373 now", "PHONE", "+1 (524) 555-7373", "+1 (524) 555-7373"),
    ("of 83.229.25.121 and", "IP", "83.229.25.121", "83.229.25.121"),
    ("card 4111 1111 1111 1111 x", "CARD", "4111 1111 1111 1111", "4111 1111 1111 1111"),
    ('token = "bc0d31ba76f17e56642e8751295a3fd50cd8e61f" a', "SECRET", "bc0d31ba76f17e56642e8751295a3fd50cd8e61f", "bc0d31ba76f17e56642e8751295a3fd50cd8e61f"),
    ("iban DE89 3704 0044 0532 0130 00.", "IBAN", "DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00"),
]


@pytest.mark.parametrize("text,kind,source,plain", CASES)
def test_found_with_source_spans(text, kind, source, plain):
    assert [(k, text[a:b], p) for k, a, b, p in pii.find(text)] == [(kind, source, plain)]
    assert source not in pii.redact(text, pii.find(text)) and f"<{kind}>" in pii.redact(text, pii.find(text))


@pytest.mark.parametrize("text", ["", "look at the dot com boom", "see you at example.com tomorrow", "three two one go", "version 2.0 of 2024", "one, two", "a at b"])
def test_clean_texts_stay(text):
    assert pii.find(text) == [] and pii.redact(text, []) == text


def test_spans_survive_any_surroundings():
    rnd = random.Random(1)
    for _ in range(200):
        text, kind, source, plain = rnd.choice(CASES)
        before = "".join(rnd.choice("ab é​. ") for _ in range(rnd.randrange(30))) + " "
        at = len(before) + text.index(source)
        assert (kind, at, at + len(source), plain) in pii.find(before + text + " end")


def test_long_texts_take_linear_time():
    began = time.time()
    for unit in ("a", "1", "1 ", "one ", " at dot", "a@", "a.", "a at a dot "):
        pii.find(unit * 40_000)
    assert time.time() - began < 60
