"""Text functions as column expressions (§2.13, RT4, CH2, CH5, AN1, AN2), and those that need Python."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG = r"(?m)(?:^|\s)#([a-zA-Z][a-zA-Z0-9_-]*)"
LOOSE_TAG = r"#(\w+)"
WIKI = r"(?<!\[)\[\[([^\[\]]+)\]\](?!\])"
LOOSE_WIKI = r"\[\[([^\]]+)\]\]"


def distinct_lower(found: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def hashtags(text: Column) -> Column:
    """Tags at a line's start or after white space, in small letters, in order of appearance."""
    return distinct_lower(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)))


def loose_hashtags(text: Column) -> Column:
    """Tags anywhere, as the graph takes them."""
    return distinct_lower(F.regexp_extract_all(text, F.lit(r"(?U)" + LOOSE_TAG), F.lit(1)))


def wiki_links(text: Column) -> Column:
    """Link targets: what follows the bar, if there is one."""
    found = F.regexp_extract_all(text, F.lit(WIKI), F.lit(1))
    target = F.transform(found, lambda x: F.trim(F.when(F.contains(x, F.lit("|")), F.substring_index(F.regexp_replace(x, r"^[^|]*\|", ""), "\u0000", 1)).otherwise(x)))
    return F.array_distinct(F.filter(target, lambda x: x != ""))


def loose_wiki_links(text: Column) -> Column:
    """Link names as the graph takes them: what precedes the bar."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(LOOSE_WIKI), F.lit(1)), lambda x: F.trim(F.substring_index(x, "|", 1))), lambda x: x != ""))


def without_parents(chunk: Column) -> Column:
    """RT17: a chunk without the headers above its own, so that a vector holds the section and not its place."""
    lead = r"\A(?:[^\S\n]*(?:#[^\n]*)?\n)+(?=[^\S\n]*#)"
    return F.when(F.rlike(chunk, F.lit(lead)), F.regexp_replace(F.regexp_replace(chunk, lead, ""), r"\A\s+|\s+\z", "")).otherwise(chunk)


def title_from_filename(path: Column) -> Column:
    """A file's stem as a title: hyphens and underscores are spaces, and each run of letters begins large."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    spaced = F.regexp_replace(stem, "[-_]", " ")
    runs = F.regexp_extract_all(spaced, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def content_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 12)


def context_header(path: Column, title: Column, tags: Column, category: Column, status: Column) -> Column:
    """CH2: the lines that say where a chunk comes from; ``tags`` is an array or null."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    name = F.coalesce(F.nullif(title, F.lit("")), F.nullif(stem, F.lit("")), F.lit("Unknown Document"))
    kind = F.coalesce(F.nullif(category, F.lit("")), F.nullif(status, F.lit("")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[Document: "), name, F.lit("]")),
        F.concat(F.lit("[Source: "), F.coalesce(path, F.lit("")), F.lit("]")),
        F.when(F.size(tags) > 0, F.concat(F.lit("[Tags: "), F.array_join(tags, ", "), F.lit("]"))),
        F.concat(F.lit("[Category: "), kind, F.lit("]")),
        F.lit("---"),
    )


def query_variants(query: Column) -> Column:
    """RT4: the spellings that a search tries, the query itself first."""
    split = F.regexp_replace(query, r"\b([A-Za-z]+)(\d+)\b", "$1 $2")
    joined = F.regexp_replace(query, r"\b([A-Za-z]+)\s+(\d+)\b", "$1$2")
    return F.when(F.length(F.trim(query)) > 0, F.array_distinct(F.array(query, F.lower(query), split, F.lower(split), joined, F.lower(joined), F.replace(query, F.lit("-"), F.lit("")), F.replace(query, F.lit("-"), F.lit(" "))))).otherwise(F.array().cast("array<string>"))


_ACRONYM_TEXT = """
ai artificial intelligence; api application programming interface; bm25 best match 25; cd continuous deployment; ci continuous integration
cli command line interface; cnn convolutional neural network; cors cross origin resource sharing; cpu central processing unit; csrf cross site request forgery
ctf capture the flag; db database; ddos distributed denial of service; dhcp dynamic host configuration protocol; dns domain name system
fts full text search; gpu graphics processing unit; ids intrusion detection system; ips intrusion prevention system; jwt json web token
k8s kubernetes; llm large language model; mitm man in the middle; ml machine learning; ner named entity recognition
nlp natural language processing; nn neural network; oauth open authorization; orm object relational mapping; os operating system
osint open source intelligence; rag retrieval augmented generation; rnn recurrent neural network; rrf reciprocal rank fusion; siem security information event management
sql structured query language; sqli sql injection; ssh secure shell; ssl secure sockets layer; tf tensorflow
tls transport layer security; vm virtual machine; vpn virtual private network; xss cross site scripting
"""
ACRONYMS: dict[str, str] = dict(x.strip().split(" ", 1) for x in re.split(r"[;\n]", _ACRONYM_TEXT) if x.strip())
MAX_VARIANTS = 12
_QUESTION = re.compile(r"(?:what (?:is|are)|how (?:to|do|does)|why (?:is|are|does)|when (?:did|does)|where (?:is|are)|who (?:is|are)) ", re.I)


def register_acronyms(more: dict[str, str]) -> None:
    """UX7: further acronyms, known from the next call on, also in the frames that are made from then on."""
    ACRONYMS.update({k.lower(): v.lower() for k, v in more.items()})


def all_query_variants(query: str | None, acronyms: dict[str, str] | None = None) -> list[str]:
    """RT4b: RT4's spellings, and underscores, dots, first and last word pairs, acronyms both ways, questions as statements; at most 12."""
    if not query or not query.strip():
        return []
    acronyms = ACRONYMS if acronyms is None else acronyms
    q, low = query, query.lower()
    found: dict[str, None] = {q: None}

    def add(*forms: str) -> None:
        for f in forms:
            found.setdefault(f)

    add(low)
    for pattern, put in ((r"\b([A-Za-z]+)(\d+)\b", r"\1 \2"), (r"\b([A-Za-z]+)\s+(\d+)\b", r"\1\2")):
        form = re.sub(pattern, put, q)
        add(form, form.lower())
    for sign in "-_.":
        if sign in q:
            for put in ("", " "):
                form = q.replace(sign, put)
                add(*((form, form.lower()) if sign == "-" else (form,)))
    words = q.split()
    if len(words) >= 3:
        for pair in (words[:2], words[-2:]):
            add(" ".join(pair), " ".join(pair).lower())
    whole = low.strip()
    back = {v: k for k, v in acronyms.items()}
    if whole in acronyms or whole in back:
        add(acronyms.get(whole) or back[whole])
    for w in low.split():
        if w in acronyms:
            add(low.replace(w, acronyms[w]))
    if m := _QUESTION.match(whole):
        rest = q[m.end() :].strip().rstrip("?")
        if rest:
            add(rest)
    return list(found)[:MAX_VARIANTS]


def variants_frame(queries: DataFrame, key: str, query: str) -> DataFrame:
    """RT4b over a frame: ``(key, n, variant)``; the acronyms known now go with it to the workers."""
    acronyms = dict(ACRONYMS)

    @F.pandas_udf("array<string>")
    def expand(q: pd.Series) -> pd.Series:
        return q.map(lambda x: all_query_variants(x, acronyms))

    return queries.select(key, F.posexplode(expand(F.col(query))).alias("n", "variant"))


ABBREVIATIONS = tuple("Ave B.A B.S Blvd Co Corp Dr Inc Jr Ltd M.A M.D M.S Mr Mrs Ms Ph.D Prof Rd Sr St cf e.g etc i.e vs".split())


def sentences(text: Column) -> Column:
    """CH5: sentences of 5 characters and more; dots of abbreviations end none."""
    held = text
    # Longer ones first; a private character stands for the dot.
    for a in sorted(ABBREVIATIONS, key=lambda x: (-len(x), x)):
        held = F.replace(held, F.lit(a + "."), F.lit(a + "\ue000"))
    parts = F.split(held, r"(?<=[.!?])\s+(?=[A-Z])|\n\s*\n")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(F.replace(s, F.lit("\ue000"), F.lit(".")), r"^\s+|\s+$", ""))), lambda s: F.length(s) >= 5)


_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def _kinds(w: str) -> str:
    """A word as c and v for consonants and vowels; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c", _kinds(w)))


def porter(word: str) -> str:
    """The stem of an English word (Porter, "An algorithm for suffix stripping", 1980)."""
    w = word
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    vowel = lambda s: "v" in _kinds(s)
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and _kinds(s)[-1] == "c"
    short = lambda s: _kinds(s)[-3:] == "cvc" and s[-1] not in "wxy"
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        hit = max(((e, r) for e, r in table if w.endswith(e)), key=lambda x: len(x[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    end = max((e for e in (*_STEP4, "ion") if w.endswith(e)), key=len, default="")
    if end:
        stem = w[: -len(end)]
        if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not short(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def stemmed(tokens: Column) -> Column:
    """Each token's Porter stem; only the distinct tokens of a batch become Python's."""

    @F.arrow_udf("array<string>")
    def stem(ts: pa.Array) -> pa.Array:
        held = ts.flatten().dictionary_encode()
        stems = pa.array([None if t is None else porter(t) for t in held.dictionary.to_pylist()], pa.string())
        ends = np.cumsum(pc.fill_null(pc.list_value_length(ts), 0).to_numpy(zero_copy_only=False), dtype=np.int32)
        offsets = pa.array(np.concatenate([np.zeros(1, np.int32), ends]), pa.int32(), mask=np.concatenate([pc.is_null(ts).to_numpy(zero_copy_only=False), [False]]))
        return pa.ListArray.from_arrays(offsets, stems.take(held.indices))

    return stem(tokens)
