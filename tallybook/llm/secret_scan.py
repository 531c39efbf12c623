"""Finding secrets: keyword prefilter, anchored patterns near its hits, checksum validation.

One Aho-Corasick automaton runs over the text and reports every keyword that can start a
secret; each pattern is then matched only at the places of its keywords. Runs of hexadecimal
digits have no keyword: a run of at least ``HEX_LENGTH`` must cover a position divisible by
that length, so only those positions are probed and grown in both directions. Kinds that
carry a checksum are reported only if it is right.

Kinds, in the order that ties are listed: ``assign`` (a name such as ``password`` given a
value), ``access`` (cloud access key ids), ``hex`` (long hexadecimal runs), ``checked`` (platform
tokens whose last six characters are the base-62 CRC-32 of the thirty before), ``jwt`` (JSON
web tokens whose header decodes), ``pem`` (private key blocks), ``card`` (16 digits in fours
that pass the Luhn check).

Defined results: null and empty texts have no spans; a null id is carried; rows are
independent, so repeated rows repeat their results; texts are scanned whole; other columns
are kept, and replaced where they have the name of a result column.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallybook.llm.tables import with_columns_in_arrow

# What secrets look like. Letters of the assignment are matched in either case, ASCII only.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LENGTH = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LENGTH = 16
HEX_DIGITS = re.compile(r"[0-9a-f]+")
HEX_LENGTH = 32
CHECKED = re.compile(r"(?:ghp|gho|ghu|ghs|ghr|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----[A-Za-z0-9+/=\s]+-----END \1-----")
CARD = re.compile(r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
KINDS = ("assign", "access", "hex", "checked", "jwt", "pem", "card")
BASE_KINDS = KINDS[:3]

_HEX = frozenset("0123456789abcdef")
_DIGITS = frozenset("0123456789")


def _right_checksum(found: re.Match) -> bool:
    value, text = zlib.crc32(found[1].encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        text = BASE62[digit] + text
    return text == found[2]


def _has_header(found: re.Match) -> bool:
    try:
        raw = base64.urlsafe_b64decode(found[1] + "=" * (-len(found[1]) % 4))
        return "alg" in json.loads(raw)
    except (binascii.Error, ValueError, TypeError):
        return False


def _passes_luhn(found: re.Match) -> bool:
    digits = [int(c) for c in found[0] if c.isdigit()]
    doubled = [d * 2 - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(digits)]
    return sum(doubled) % 10 == 0


#: kind -> (pattern, whether a match counts)
_ANCHORED = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= ASSIGN_LENGTH),
    "access": (ACCESS, lambda m: len(m[0]) >= ACCESS_LENGTH),
    "checked": (CHECKED, _right_checksum),
    "jwt": (JWT, _has_header),
    "pem": (PEM, lambda m: True),
    "card": (CARD, _passes_luhn),
}
#: Kinds whose pattern begins with a run that decides, by what follows it, for all hits in it: of a failed
#: match, hits up to the end of that run fail as well and are passed over.
_DECIDING_RUN = {"jwt": re.compile(r"[A-Za-z0-9_-]+")}
#: Characters of a card number up to the one before its first separator.
_CARD_LEAD = 3


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word, ("assign", len(word)))
    # the text is scanned with A-Z lower-cased; the patterns then look at the original
    for word in ("AKIA", *CHECKED_WORDS, "eyJ", "-----BEGIN "):
        kind = "access" if word == "AKIA" else "jwt" if word == "eyJ" else "pem" if word[0] == "-" else "checked"
        found.add_word(word.lower(), (kind, len(word)))
    # a card number is met at the digit before each separator
    for a in "0123456789":
        for separator in " -":
            for b in "0123456789":
                found.add_word(a + separator + b, ("card", 3))
    found.make_automaton()
    return found


def _hex_spans(text: str) -> list[tuple[int, int]]:
    spans, end, n = [], 0, len(text)
    for at in range(0, n, HEX_LENGTH):
        if at < end or text[at] not in _HEX:
            continue
        start = at
        while start > end and text[start - 1] in _HEX:
            start -= 1
        end = HEX_DIGITS.match(text, at).end()
        if end - start >= HEX_LENGTH:
            spans.append((start, end))
    return spans


def find_spans(text: str, automaton) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret, sorted by start and then by kind as listed.

    Per kind, matches are leftmost and do not overlap; a match that does not count still
    takes its place, as it does when a pattern is run over the whole text.
    """
    # bytes.lower() changes A-Z alone, so places stay the same
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits: dict[str, list[int]] = {}
    for last, (kind, length) in automaton.iter(lowered):
        hits.setdefault(kind, []).append(last + 1 - length)
    spans = [(start, "hex", end) for start, end in _hex_spans(text)]
    for kind, places in hits.items():
        pattern, counts = _ANCHORED[kind]
        end = 0
        if kind == "card":
            # a number begins where no digit stands before it
            places = [p - _CARD_LEAD for p in places if p >= _CARD_LEAD and not (p > _CARD_LEAD and text[p - _CARD_LEAD - 1] in _DIGITS)]
        for start in sorted(places):
            if start < end:
                continue
            if found := pattern.match(text, start):
                end = found.end()
                if counts(found):
                    spans.append((start, kind, end))
            elif kind in _DECIDING_RUN:
                end = _DECIDING_RUN[kind].match(text, start).end()
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def scan(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: array<struct<kind, start, end>> in code points, end exclusive."""
    span = T.StructType().add("kind", "string").add("start", "long").add("end", "long")
    new = T.StructType().add("secrets", T.ArrayType(span))
    return _mapped(docs, column, new, lambda spans: [[{"kind": k, "start": s, "end": e} for s, k, e in spans]])


def scan_digest(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with counts of the base kinds, a digest of their spans, and all spans as one string."""
    new = T.StructType()
    for kind in BASE_KINDS:
        new.add(f"n_{kind}", "long")
    new.add("base_sha256", "string").add("spans", "string")

    def digest(spans: list[tuple[int, str, int]]) -> list:
        base = [s for s in spans if s[1] in BASE_KINDS]
        line = ",".join(f"{k}:{s}:{e}" for s, k, e in base)
        counts = [sum(s[1] == kind for s in base) for kind in BASE_KINDS]
        return [
            *counts, hashlib.sha256(line.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, k, e in spans)
        ]

    return _mapped(docs, column, new, digest)


def _mapped(docs: DataFrame, column: str, new: T.StructType, result) -> DataFrame:
    """``docs`` without its text column, and the values ``result`` makes of each row's spans."""

    def worker():
        automaton = _automaton()

        def make(columns):
            rows = [result(find_spans(text.as_py() or "", automaton)) for text in columns[0]]
            return list(zip(*rows, strict=True)) if rows else [[] for _ in new.fields]

        return make

    return with_columns_in_arrow(docs, [docs[f"`{column}`"].cast("string")], new, worker, drop=(column,))
