"""Personal data by anchor expansion.

An Aho-Corasick automaton runs over a text once and finds anchors: at-signs and what
people write for them, schemes of addresses, marks beside digits and cue words of
identifiers. At each anchor a parser of its kind looks at the characters around it, sets the borders
and validates what lies between; an anchor costs what its own span and the word beside it hold.

Base kinds, each leftmost and non-overlapping, as the patterns

    email   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip      [0-9]+(\\.[0-9]+){3}, parts of 255 at most
    card    [0-9]([\\x20-]?[0-9])+, 16 to 19 digits with Luhn's check
    phone   \\+[0-9][\\x20().0-9-]+[0-9], 8 to 15 digits

find them; a match that fails its check is dropped and what it covered is not tried again.

Further kinds, reported unless a base span covers them:

    mailbox  an address with letters beyond ASCII, or with "at" and "dot" in brackets
    login    user or user:password between a scheme and the host's at-sign
    ip6      eight groups, or fewer around one "::", as the standard's parser accepts; three groups at least
    iban     of the length that its country has, with the check of remainder 97
    account  six to 17 digits after a cue (account, passport, social security number and the like)

One narrow pass. Places are code points, ends exclusive.

Defined results: a null or empty text has no spans; very long texts are scanned whole; spans are
by kind as listed, then start; repeated rows are scanned one by one; an empty table gives no
rows; other columns are not read, so they may have any name.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import holding, pieces, require, worker_cache

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "mailbox", "login", "ip6", "iban", "account")
#: Characters of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
#: Cues of account numbers: as written here, capitalised, and in capitals.
CUES = (
    "account", "acct", "iban", "passport", "ssn", "social security", "tax id", "customer id", "member id", "driver license", "driving licence", "konto", "kontonummer", "reisepass", "steuernummer",
    "sozialversicherungsnummer", "cuenta", "pasaporte", "compte", "passeport", "sécurité sociale",
)
#: What is written for an at-sign.
AT = ("(at)", "[at]", "{at}", " at ")
_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LABEL = r"[^\W_](?:[^\W_]|-(?=[^\W_]))*"
_WIDE_DOMAIN = re.compile(rf"{_LABEL}(?:\.{_LABEL})*\.[^\W\d_]{{2,}}")
#: "dot" in brackets, or a full stop; after a bare " at ", only the word in blanks or brackets.
_SPOKEN_DOT = r"\x20?(?:\(dot\)|\[dot\]|\{dot\}|\(punkt\)|\(punto\)|\(point\))\x20?|\x20dot\x20"
_SPOKEN = re.compile(rf"\x20?([A-Za-z0-9-]+(?:(?:{_SPOKEN_DOT}|\.)[A-Za-z0-9-]+)*(?:{_SPOKEN_DOT}|\.)[A-Za-z]{{2,}})(?![A-Za-z0-9])", re.I)
_BARE = re.compile(rf"([A-Za-z0-9-]+(?:(?:{_SPOKEN_DOT})[A-Za-z0-9-]+)*(?:{_SPOKEN_DOT})[A-Za-z]{{2,}})(?![A-Za-z0-9])", re.I)
_USER = re.compile(r"[^\s/@:?#<>\"']+(?::[^\s/@?#<>\"']*)?(?=@[A-Za-z0-9\[])")
_IP6 = re.compile(r"[0-9A-Fa-f:]*:[0-9A-Fa-f:]*(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3})?")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9])+")
_ACCOUNT = re.compile(r"(?:\x20?(?:number|num|no|nr|nummer|numéro|número|id|code|#|n°|nº)\.?)?\x20?(?:is|ist|es|est|:|=|#)?\x20?([0-9](?:[\x20.-]?[0-9])*)(?![0-9A-Za-z])", re.I)

_AUTOMATA: dict[str, ahocorasick.Automaton] = worker_cache({})


def automaton() -> ahocorasick.Automaton:
    """All anchors, each with its kinds and length."""
    if "anchors" not in _AUTOMATA:
        anchors: dict[str, list[str]] = {"@": ["email", "mailbox"], "://": ["login"], "::": ["ip6"]}
        for d in _DIGITS:
            anchors[d] = ["card"]
            anchors[f".{d}"] = ["ip"]
            anchors[f"+{d}"] = ["phone"]
        for h in "0123456789abcdefABCDEF":
            anchors[f":{h}"] = ["ip6"]
        for at in AT:
            for form in dict.fromkeys((at, at.upper())):
                anchors[form] = ["spoken"]
        for country in IBAN_LENGTHS:
            for d in _DIGITS:
                anchors[f"{country}{d}"] = ["iban"]
        for cue in CUES:
            for form in dict.fromkeys((cue, cue.capitalize(), cue.title(), cue.upper())):
                anchors[form] = ["account"]
        made = ahocorasick.Automaton()
        for anchor, kinds in anchors.items():
            made.add_word(anchor, (kinds, len(anchor)))
        made.make_automaton()
        _AUTOMATA["anchors"] = made
    return _AUTOMATA["anchors"]


def luhn(digits: str) -> bool:
    """Luhn's check: every second digit from the right is doubled, 9 less beyond 9."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    """The number with its first four characters last, letters as 10 to 35, leaves 1 of 97."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


class _Scan:
    """Parsers over one text; ``past`` is where the last match of a kind ended."""

    def __init__(self, text: str):
        self.text = text
        self.past = dict.fromkeys((*KINDS, "spoken"), 0)
        self.spans: list[tuple[str, int, int]] = []

    def found(self, kind: str, a: int, b: int) -> None:
        self.spans.append((kind, a, b))

    def back(self, at: int, chars, least: int) -> int:
        """Where the run of ``chars`` that ends at ``at`` begins, not before ``least``."""
        text = self.text
        while at > least and text[at - 1] in chars:
            at -= 1
        return at

    def email(self, a: int, b: int) -> None:
        start = self.back(a, _LOCAL, self.past["email"])
        if start < a and (m := _DOMAIN.match(self.text, b)):
            self.past["email"] = m.end()
            self.found("email", start, m.end())

    def mailbox(self, a: int, b: int) -> None:
        """An address that holds a letter beyond ASCII."""
        text, start, least = self.text, a, self.past["mailbox"]
        while start > least and (text[start - 1] in _LOCAL or ord(text[start - 1]) > 127 and text[start - 1].isalnum()):
            start -= 1
        while start < a and not text[start].isalnum():
            start += 1
        if start < a and (m := _WIDE_DOMAIN.match(text, b)) and not text[start : m.end()].isascii():
            self.past["mailbox"] = m.end()
            self.found("mailbox", start, m.end())

    def spoken(self, a: int, b: int) -> None:
        bare = self.text[a] == " "
        end = a - 1 if not bare and a and self.text[a - 1] == " " else a
        start = self.back(end, _LOCAL, self.past["spoken"])
        while start < end and not self.text[start].isalnum():
            start += 1
        if start < end and (m := (_BARE if bare else _SPOKEN).match(self.text, b)):
            self.past["spoken"] = m.end()
            self.found("mailbox", start, m.end())

    def login(self, a: int, b: int) -> None:
        if m := _USER.match(self.text, b):
            self.found("login", b, m.end())

    def ip(self, a: int, b: int) -> None:
        past = self.past["ip"]
        start = self.back(a, _DIGITS, past) if a >= past else a
        if start < a and (m := _IP.match(self.text, start)):
            self.past["ip"] = m.end()
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (g.lstrip("0") for g in m[0].split("."))):
                self.found("ip", start, m.end())

    def ip6(self, a: int, b: int) -> None:
        past = self.past["ip6"]
        if a < past:
            return
        start = self.back(a, "0123456789abcdefABCDEF:", past)
        m = _IP6.match(self.text, start)
        self.past["ip6"] = m.end()
        end = m.end()
        while end > start and self.text[end - 1] == ":" and self.text[end - 2 : end] != "::":
            end -= 1
        own = self.text[start:end]
        beside = (start and (self.text[start - 1].isalnum() or self.text[start - 1] in "_.")) or self.text[end : end + 1].isalnum()
        if not beside and own.count(":") >= 2 and len([g for g in own.split(":") if g]) >= 3 and len(own) <= 45:
            try:
                ipaddress.IPv6Address(own)
            except ValueError:
                return
            self.found("ip6", start, end)

    def card(self, a: int, b: int) -> None:
        if a >= self.past["card"] and (m := _CARD.match(self.text, a)):
            self.past["card"] = m.end()
            if m.end() - a >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    self.found("card", a, m.end())

    def phone(self, a: int, b: int) -> None:
        if a >= self.past["phone"] and (m := _PHONE.match(self.text, a)):
            self.past["phone"] = m.end()
            if 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                self.found("phone", a, m.end())

    def iban(self, a: int, b: int) -> None:
        if a < self.past["iban"] or a and self.text[a - 1].isalnum():
            return
        if m := _IBAN.match(self.text, a):
            need, end = IBAN_LENGTHS[m[0][:2]], a
            while end < m.end() and need:
                need -= self.text[end] != " "
                end += 1
            own = self.text[a:end].replace(" ", "")
            if not need and own.isascii() and not self.text[end : end + 1].isalnum() and iban_valid(own.upper()):
                self.past["iban"] = end
                self.found("iban", a, end)

    def account(self, a: int, b: int) -> None:
        if a and self.text[a - 1].isalnum():
            return
        if (m := _ACCOUNT.match(self.text, b)) and m.start(1) > b and 6 <= sum(c in _DIGITS for c in m[1]) <= 17:
            self.found("account", *m.span(1))


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by kind and then start."""
    if not text:
        return []
    scan = _Scan(text)
    for last, (kinds, size) in automaton().iter(text):
        for kind in kinds:
            getattr(scan, kind)(last + 1 - size, last + 1)
    if not scan.spans:
        return []
    base = sorted((a, b) for k, a, b in scan.spans if k in BASE)
    starts, ends = [a for a, _ in base], list(accumulate((b for _, b in base), max))

    def covered(a: int, b: int) -> bool:
        i = bisect_right(starts, a)
        return i > 0 and ends[i - 1] >= b

    spans = [s for s in dict.fromkeys(scan.spans) if s[0] in BASE or not covered(*s[1:])]
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, spans array<struct<kind, start, end>>."""
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding(_AUTOMATA)
        for batch in batches:
            for part in pieces(batch, 1):
                found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    of = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task, f"doc_id {of}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data as its kind in angle brackets; overlapping spans as the first of them."""
    require(docs, id_col, text_col)
    at = docs.columns.index(text_col)

    def hidden(text: str | None) -> str | None:
        if not text:
            return text
        out, past = [], 0
        for kind, a, b in sorted(find(text), key=lambda s: (s[1], -s[2])):
            if a >= past:
                out += [text[past:a], f"<{kind}>"]
            past = max(past, b)
        return "".join([*out, text[past:]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding(_AUTOMATA)
        for batch in batches:
            for part in pieces(batch, at):
                text = pa.array([hidden(t) for t in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(part.columns)], names=part.schema.names)

    return docs.mapInArrow(task, docs.schema)
