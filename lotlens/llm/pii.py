r"""Personal data: regular expressions propose spans, validators confirm them, context adjusts the score.

Kinds, leftmost and non-overlapping per kind over the whole text:

* ``email``  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``
* ``ip``     four dotted runs of digits, each at most 255
* ``card``   ``[0-9]([\x20-]?[0-9])+``, 13 to 19 digits that pass Luhn
* ``phone``  ``\+[0-9][\x20().0-9-]+[0-9]``, 9 to 15 digits
* ``iban``   two letters, two check digits, 11 to 30 letters and digits (in one run, or in fours),
  mod-97 remainder 1; groups beyond the length of the country's IBANs are words of their own if what is before them passes

The first four are the base kinds: what their pattern and validator accept
stays, whatever its score.  IBANs are what the method adds; they have to
reach ``MIN_SCORE``.  A span's score is its kind's prior, raised by words
nearby that speak of such data and lowered by words that speak of other
numbers.

The expressions below find the same spans as those above but never go back
over a text: runs are matched possessively from their beginnings, and e-mail
addresses are read outwards from each ``@``, so a long run of one character
class costs its length, not its square.

A row's spans depend on that row alone, so there is no shuffle and no key to
be skewed.  Offsets are code points, ends exclusive.

Defined results: a null or empty text has no spans; repeated rows each get
their result; an empty table gives an empty one; further input columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")

#: Score of a confirmed span without context; what helping and misleading words add; what an added span needs.
PRIORS = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8}
HELP, MISLEAD, MIN_SCORE = 0.2, -0.3, 0.6
#: Code points before and after a span that count as near.
NEAR = 40
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer", "konto"),
}
MISLEADING = ("isbn", "version", "checksum", "serial", "order", "example")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}"
                   r"(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {country: length for length, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}
_WORDS = re.compile(r"[A-Za-z][A-Za-z-]*")
_NOT_DIGITS = re.compile(r"[^0-9]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled (nines cast out), the sum divisible by ten."""
    total = sum(map(int, digits[-1::-2]))
    total += sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """IBAN check: the first four characters last, letters as 10 to 35, remainder 1 of 97."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0  # nothing before this may be used again
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = at  # a later address begins after this "@"
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(part := g.lstrip("0")) <= 3 and int(part or "0") <= 255 for g in m.groups()):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    m = _IBAN.search(text)
    while m:
        known = m[0]
        while len(known.replace(" ", "")) > IBAN_LENGTHS.get(known[:2], 0):
            known = known.rpartition(" ")[0]  # the last group may be a word that follows
        if len(known.replace(" ", "")) != IBAN_LENGTHS.get(m[0][:2]):
            known = m[0]
        account = next((x for x in (known, m[0]) if mod97(x.replace(" ", ""))), "")
        if account:
            yield m.start(), m.start() + len(account)
        # what is left of the match may begin another
        m = _IBAN.search(text, m.start() + (len(account) or 4))


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, adjusted by the words within ``NEAR`` code points."""
    near = {w.lower() for w in _WORDS.findall(text[max(0, start - NEAR):start] + " " + text[end:end + NEAR])}
    change = HELP * any(w in near for w in CONTEXT[kind]) + MISLEAD * any(w in near for w in MISLEADING)
    return min(1.0, max(0.0, PRIORS[kind] + change))


def find_spans(text: str | None) -> list[Span]:
    """All spans by kind as listed, then start."""
    if not text:
        return []
    found = []
    for kind in KINDS:
        for start, end in _FINDERS[kind](text):
            s = score(text, kind, start, end)
            if kind in BASE_KINDS or s >= MIN_SCORE:
                found.append(Span(kind, start, end, s))
    return found


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, spans (array of kind, start, end, score)."""
    @F.pandas_udf("array<struct<kind string, start bigint, end bigint, score double>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [s._asdict() for s in find_spans(t)])

    return docs.select(F.col(id_col).alias("doc_id"), spans(F.col(text_col)).alias("spans"))


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, a count per kind, base_sha256, spans (text), max_score."""
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)

    @F.pandas_udf(f"{counts}, base_sha256 string, spans string, max_score double")
    def report(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = find_spans(text)
            base = [s for s in spans if s.kind in BASE_KINDS]
            rows.append((*(sum(s.kind == k for s in spans) for k in KINDS),
                         hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans),
                         max((s.score for s in spans), default=0.0)))
        return pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "max_score"])

    return docs.select(F.col(id_col).alias("doc_id"), report(F.col(text_col)).alias("r")).select("doc_id", "r.*")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets (the longest wins an overlap)."""
    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else _redact(t))

    return docs.withColumn(text_col, redact(F.col(text_col)))


def _redact(text: str) -> str:
    parts, at = [], 0
    for s in sorted(find_spans(text), key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            parts += [text[at:s.start], f"[{s.kind.upper()}]"]
            at = s.end
        else:
            at = max(at, s.end)
    return "".join([*parts, text[at:]])
