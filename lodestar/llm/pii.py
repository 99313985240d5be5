"""Operator 5, personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs before a digit, digits,
`://` and cues such as "iban" or "account". At each anchor a small deterministic parser expands to
the left and right and validates what it found: an email around its at-sign, an IP address and a
card number from the first digit of a run, a phone number from its plus sign, a user in a web
address from its scheme, an account number after its cue. Each kind keeps the place where its last
match ended, so spans of a kind never overlap; spans of different kinds may.

Null and empty texts have no spans; a row of the input gives a row of the result.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .spans import Finder, as_text, count, digest, find_spans

#: The order in which spans with the same start are reported.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "account", "url")
#: Words that announce an account or identity number; each also in title and upper case.
CUES = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security"),
    "account": ("account", "acct", "konto", "kontonummer", "cuenta", "compte", "passport"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_DIGIT = frozenset("0123456789")
_PHONE = frozenset(" ().0123456789-")
_AFTER_CUE = re.compile(r"(?: ?(?:number|no|nr|num)\.?)?[ \t]*[:#=]?[ \t]*", re.I | re.A)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")
_USER = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+(?::[^\s/@]*)?@[A-Za-z0-9.-]+[A-Za-z0-9](?::[0-9]+)?")
_RANK = {k: i for i, k in enumerate(KINDS)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _run(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (more := _run(text, end + 1, _LABEL)) > end + 1:
        end, dots = more, dots + 1
    return (start, end) if dots else None


def _card(text: str, at: int) -> tuple[int, int]:
    """End of the run of digits with single blanks or hyphens between, and how many digits."""
    end, digits, n = at + 1, 1, len(text)
    while end < n:
        if text[end] in _DIGIT:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGIT:
            end += 2
        else:
            break
        digits += 1
    return end, digits


def _ip(text: str, at: int) -> tuple[int, list[str]]:
    """End and parts of as many dotted numbers as there are, four at most."""
    end = _run(text, at, _DIGIT)
    parts = [text[at:end]]
    while len(parts) < 4 and end < len(text) and text[end] == "." and (more := _run(text, end + 1, _DIGIT)) > end + 1:
        parts.append(text[end + 1 : more])
        end = more
    return end, parts


def _phone(text: str, at: int) -> int:
    """End of a plus sign, a digit, and at least one sign and a digit of the run after it; at if none."""
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGIT:
        end -= 1
    return end if end > at + 3 else at


def finder() -> Finder:
    """A function from a text to its spans, in order of start, then kind."""
    anchors = ahocorasick.Automaton()
    for d in "0123456789":
        anchors.add_word(d, ("digit", 1))
    anchors.add_word("@", ("email", 1))
    anchors.add_word("+", ("phone", 1))
    anchors.add_word("://", ("url", 3))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue.title(), cue.capitalize(), cue.upper()}:
                anchors.add_word(form, (kind, len(form)))
    anchors.make_automaton()

    def find(text: str) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        free = dict.fromkeys(KINDS, 0)  # where the next match of a kind may begin

        def put(kind: str, start: int, end: int) -> None:
            out.append((kind, start, end))
            free[kind] = end

        for last, (anchor, length) in anchors.iter(text):
            at = last - length + 1
            if anchor == "digit":
                if at >= free["card"]:
                    end, digits = _card(text, at)
                    free["card"] = end
                    if 12 <= digits <= 19 and luhn(re.sub("[ -]", "", text[at:end])):
                        put("card", at, end)
                if at >= free["ip"]:
                    end, parts = _ip(text, at)
                    if len(parts) < 4:
                        free["ip"] = at + len(parts[0])  # no later start in this number can do better
                    else:
                        free["ip"] = end
                        if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in parts):
                            put("ip", at, end)
            elif anchor == "email":
                if at >= free["email"] and (found := _email(text, at, free["email"])):
                    put("email", *found)
            elif anchor == "phone":
                if at >= free["phone"] and text[at + 1 : at + 2] in _DIGIT and (end := _phone(text, at)) > at:
                    free["phone"] = end
                    if 9 <= sum(c in _DIGIT for c in text[at:end]) <= 15:
                        put("phone", at, end)
            elif anchor == "url":
                if last + 1 >= free["url"] and (m := _USER.match(text, last + 1)):
                    start = at
                    while start > free["url"] and text[start - 1].isascii() and text[start - 1].isalpha():
                        start -= 1
                    if start < at:
                        put("url", start, m.end())
            elif not (at and text[at - 1].isalnum()):
                m = {"iban": _IBAN, "ssn": _SSN, "account": _ACCOUNT}[anchor].match(text, _AFTER_CUE.match(text, last + 1).end())
                if m and m.start() >= free[anchor] and m.start() > last + 1 and (anchor != "iban" or iban_holds(m[0])):
                    put(anchor, *m.span())
        return sorted(out, key=lambda s: (s[1], _RANK[s[0]], s[2]))

    return find


def find_personal_data(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns keep of docs (all by default) and spans, an array of (kind, start, end)."""
    return find_spans(docs, finder, keep, text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span in its text replaced by the kind in angle brackets."""
    return find_spans(docs, finder, None, text, redact=True, name="lodestar_spans").drop("lodestar_spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"), ["doc_id"])
    spans = F.col("spans")
    return found.select("doc_id", *[count(spans, k).alias(f"n_{k}") for k in BASE], digest(spans, *BASE).alias("base_sha256"), as_text(spans).alias("spans"))
