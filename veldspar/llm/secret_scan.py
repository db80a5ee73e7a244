"""Secret scans with a guess-cost model.

Base spans come from three patterns (assignments of credentials, access key ids,
long hex runs). Further spans come from values in a credential context (a key
word, a mark, a value): each value is segmented at least cost into dictionary
words, dates, repeats, keyboard walks and brute-force stretches by dynamic
programming, and it is a secret if even the cheapest way to guess it takes
``min_bits`` bits. Only a value that lies in one base span as a whole is not
reported again; one that reaches beyond its base span is.

A segment takes 1 bit for its choice, and: a word the logarithm of its rank + 1,
more for capitals and for digits in place of letters; a date that of the dates in
question; a repeat that of its character and length; a walk (keys side by side, or
characters in sequence) that of 47 starts and its length, and 2 bits for each turn;
a brute-force stretch the bits of its characters. Words are ``WORDS`` and then
those that a vocabulary file lists, in its order; words of more than 20 letters are none. A value ends at white
space; one that holds letters alone, some of them beyond ASCII, is left out, as no vocabulary tells whether it is a word.

One narrow pass. Places are code points, ends exclusive.

Defined results: a null or empty text has no spans; very long texts and values
are scanned whole (the segmentation of a value ends where no way is left under
``min_bits``); spans that start together are in the order of ``KINDS``; repeated
rows are scanned one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping
from math import inf, log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import holding, pieces, require, worker_cache

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|passwort|contraseña|clave|mot\x20de\x20passe|secret|token|credentials?|auth|bearer|pin|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key|client[\x20_-]?secret)["']?\x20*(?:[:=]+>?|\x20is\x20|\x20ist\x20|\x20est\x20|\x20es\x20)\x20*["'`]?([^\s\x00-\x20\x7F]{6,})""",
    re.I,
)
#: Without one of these there is no context.
_MARK = re.compile(r"[:=]|\x20(?:is|ist|est|es)\x20", re.I)
#: Common words of passwords, commonest first; a word's place is its number of guesses.
WORDS = (
    "password pass admin letmein welcome login secret token key user test guest root master hello dragon monkey love "
    "football baseball shadow sunshine princess qwerty iloveyou superman batman trustno computer internet service server "
    "system default changeme access account private public example sample demo temp summer winter spring autumn january "
    "february march april may june july august september october november december monday tuesday wednesday thursday "
    "friday saturday sunday company office home house money happy lucky magic power prince queen king star soccer hockey "
    "ginger pepper cookie cheese banana orange apple purple silver golden black white green blue red the and for you not "
    "this that with from have will your name word none null true false empty unknown"
).split()
_RANKS = {w: i + 1 for i, w in enumerate(WORDS)}
#: Vocabulary words of so many letters count.
SHORTEST, LONGEST = 3, 20
_LEET = str.maketrans("@4310$57!", "aaeiosstl")
_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, k + r / 2) for r, row in enumerate(_ROWS) for k, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d(?:([-./]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-./]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
#: Bits of one brute-force character by its kind, and of the choice of a segment.
_LOWER, _UPPER, _DIGIT, _OTHER, _SEGMENT = log2(26), log2(26) + 0.7, log2(10), log2(33), 1.0


_VOCABULARIES: dict[str, dict[str, int]] = worker_cache({})


def ranks(path: str | None) -> dict[str, int]:
    """Ranks of words: ``WORDS``, then the whole words of a tokenizer's vocabulary file in the order of its ids."""
    if path is None:
        return _RANKS
    if path not in _VOCABULARIES:
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        found = dict(_RANKS)
        for piece in sorted(vocabulary, key=vocabulary.__getitem__):
            word = piece[1:].lower()  # the first character marks a blank before the word
            if piece[0] in "Ġ▁" and SHORTEST <= len(word) <= LONGEST and word.isascii() and word.isalpha():
                found.setdefault(word, len(found) + 1)
        _VOCABULARIES[path] = found
    return _VOCABULARIES[path]


def _step(a: str, b: str) -> tuple[float, float] | int | None:
    """How one gets from a to b: the way on the keyboard, the step in a sequence, or none."""
    p, q = _PLACE.get(a), _PLACE.get(b)
    if p and q and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1:
        return q[0] - p[0], q[1] - p[1]
    if abs(ord(a) - ord(b)) == 1 and a.isalnum() and b.isalnum():
        return ord(b) - ord(a)
    return None


def _char_bits(c: str) -> float:
    return _LOWER if c.islower() else _UPPER if c.isupper() else _DIGIT if c.isdigit() else _OTHER


def _word_bits(part: str, low: str, plain: str, rank: int) -> float:
    capitals = 0 if part == low else 1 if part.istitle() or part.isupper() else len(part)
    return log2(rank + 1) + capitals + (low != plain) * 2


def segments(value: str, words: Mapping[str, int] = _RANKS, most: float = inf) -> list[tuple[str, int, int, float]] | None:
    """Cheapest segmentation: (kind, start, end, bits) of each part; None if it takes ``most`` bits or more."""
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(_LEET)
    # Least costs up to each place: in any way, and with brute force at its end.
    best, brute = [0.0] + [inf] * n, [inf] * (n + 1)
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    began = [0] * (n + 1)  # where the brute force that ends here starts
    same = walk = 0  # starts of the repeat and the walk that the last character ends
    turns = [0] * (n + 2)  # turns of walks up to each place
    last = None
    starts: list[tuple[int, float]] = []  # of walks: place, and cost without turns and length
    for j in range(1, n + 1):
        c = value[j - 1]
        bits = _char_bits(c)
        if j > 1:
            if c != value[j - 2]:
                same = j - 1
            step = _step(low[j - 2], low[j - 1])
            if step is None:
                walk, starts = j - 1, []
            turns[j] = turns[j - 1] + (step is not None and last is not None and step != last)
            last = step

        # Brute force goes on without another choice.
        if best[j - 1] + _SEGMENT < brute[j - 1]:
            brute[j], began[j] = best[j - 1] + _SEGMENT + bits, j - 1
        else:
            brute[j], began[j] = brute[j - 1] + bits, began[j - 1]
        cost, way = brute[j], ("brute", began[j])
        # A later start in a repeat costs more, unless other segments end inside it.
        for i in range(same, min(j - 2, same + LONGEST + 1)):
            if (new := best[i] + _SEGMENT + bits + log2(j - i)) < cost:
                cost, way = new, ("repeat", i)
        if j - walk > 2:
            # A start that costs more than one before it at any length from here on is left out, and so is one no better than a later one.
            i = j - 3
            key = best[i] + _SEGMENT + log2(47) - 2 * turns[i + 2]
            if all(k + log2(1 + (i - h) / 3) > key for h, k in starts):
                while starts and starts[-1][1] >= key:
                    starts.pop()
                starts.append((i, key))
            for i, key in starts:
                if (new := key + log2(j - i) + 2 * turns[j]) < cost:
                    cost, way = new, ("walk", i)
        for i in range(max(0, j - LONGEST), j - SHORTEST + 1):
            rank = words.get(plain[i:j]) or words.get(low[i:j])
            if rank and (new := best[i] + _SEGMENT + _word_bits(value[i:j], low[i:j], plain[i:j], rank)) < cost:
                cost, way = new, ("word", i)
        if c.isdigit():
            for size in (4, 8, 10):
                if j >= size and _DATE.fullmatch(value, j - size, j):
                    new = best[j - size] + _SEGMENT + (log2(130) if size == 4 else log2(130 * 366) + (size - 8))
                    if new < cost:
                        cost, way = new, ("date", j - size)
        best[j], back[j] = cost, way
        if cost >= most and min(best[max(0, j - LONGEST) : j + 1] + best[same : same + LONGEST + 1]) >= most and all(k + 2 * turns[j] >= most for _, k in starts):
            return None
    if best[n] >= most:
        return None
    out = []
    j = n
    while j > 0:
        kind, i = back[j]
        out.append((kind, i, j, best[j] - best[i]))
        j = i
    return out[::-1]


def guess_bits(value: str, words: Mapping[str, int] = _RANKS) -> float:
    """Base-2 logarithm of the guesses that the cheapest segmentation takes."""
    return sum(s[3] for s in segments(value, words) or ())


def find(text: str | None, min_bits: float = 36.0, words: Mapping[str, int] = _RANKS) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by start and then kind."""
    if not text:
        return []
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    base = list(out)
    if _MARK.search(text):
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip("\"'`,;.)")
            a = m.start(1)
            b = a + len(value)
            if not value.isascii() and value.isalpha():  # words are ASCII ones; others' are no secrets for that
                continue
            if segments(value, words, min_bits) is None and not any(x <= a and b <= y for _, x, y in base):
                out.append(("guess", a, b))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_bits: float = 36.0, vocabulary: str | None = None) -> DataFrame:
    """Per document: doc_id, spans array<struct<kind, start, end>>.

    ``vocabulary`` is the path of a tokenizer's vocabulary (.json) that every executor has.
    """
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding(_VOCABULARIES)
        words = ranks(vocabulary)
        for batch in batches:
            for part in pieces(batch, 1):
                found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t, min_bits, words)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    of = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task, f"doc_id {of}, spans array<struct<kind: string, start: bigint, end: bigint>>")
