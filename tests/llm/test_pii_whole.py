import pytest

from corvane.llm import pii

ADDRESSES = [
    ("anna [at] firma [dot] pl", "anna@firma.pl"),
    ("anna at firma dot jp", "anna@firma.jp"),
    ("anna (at) firma.ca", "anna@firma.ca"),
    ("anna (at) firma.photography", "anna@firma.photography"),
    ("anna@firma [dot] photography", "anna@firma.photography"),
    ("anna at firma [dot] photography", "anna@firma.photography"),
    ("anna [at] uol [dot] com [dot] br", "anna@uol.com.br"),
    ("anna at uol dot com dot br", "anna@uol.com.br"),
]


@pytest.mark.parametrize("text,plain", ADDRESSES)
def test_any_ending(text, plain):
    assert [(k, a, b, p) for k, a, b, p in pii.find(f"to {text}, ok")] == [("EMAIL", 3, 3 + len(text), plain)]


@pytest.mark.parametrize("text", ["we meet at home. then we go", "look at the dot on it", "come at noon (point of order)", "see anna at work. it rains"])
def test_prose_stays(text):
    assert pii.find(text) == []


@pytest.mark.parametrize("before,secret", [("token=", "aB3/" * 113 + "x"), ("", "0a" * 300), ("", "sk-" + "Ab1" * 60), ("password: ", "q" * 100_000)])
def test_secrets_to_their_end(before, secret):
    text = f"set {before}{secret} now"
    assert pii.redact(text, pii.find(text)) == f"set {before}<SECRET> now"
