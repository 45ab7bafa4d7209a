"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in a text: the at-sign, digits, the
plus sign, URL schemes and cue words of identifiers.  From an at-sign the span
grows left over the letters of a local part and right over the labels of a
domain.  From the other anchors it is widened to the run of characters its kind
may hold, and a deterministic parser looks at that run only.  A match never
leaves its run and every match holds an anchor, so the matches are those of the
patterns over the whole text.  Each kind's runs follow one another, so the work
is linear in the text, also for one run of a million letters or digits.

Kinds, in order: ``email``, ``ip``, ``card`` and ``phone`` are fixed by pattern
and check (below); ``url`` is an address that begins with a scheme; ``account``
is an identifier behind a cue (``token``, ``account``, ``iban`` ...), an
optional separator and optional quotes: at least six letters, digits or joining
signs, a digit among them.  Behind ``iban`` the number may stand in groups; then
its check digits say where it ends, and a grouped number that fails them at every
group is read as the others are.  Spans are code points, end exclusive.

A null text has no spans, like an empty one.  Texts of any length are taken
whole; memory follows the longest text of a batch.  Spans of different kinds may
overlap (an address in a URL is both), those of one kind never do.  A row's spans
follow from its own text: repeated rows get equal ones, an empty table gives an
empty one, and other columns, whatever their names, are left as they are.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.shared import ship

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = 4

# The patterns that the base kinds are defined by.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("token", "account", "acct", "iban", "passport", "ssn", "api_key", "apikey", "secret", "password", "licence no", "license no")

_URL = re.compile(r"(?i:https?|ftp)://[^\s\"'<>()\[\]{}|\\^`]+|(?i:mailto):[^\s\"'<>()]+")
_TO_VALUE = r"[ \t]*+(?:(?:number|no\.?|id)[ \t]*+)?[:=#]?[ \t]*+([\"']?)"
_BEHIND = re.compile(_TO_VALUE + r"([A-Za-z0-9][A-Za-z0-9_-]{4,}[A-Za-z0-9])(?:\1)", re.I)
_IBAN = re.compile(_TO_VALUE + r"([A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30})(?![A-Z0-9])", re.I)
_GROUP_END = re.compile(r"[A-Za-z0-9](?=[ -]|$)")

_LOCAL = frozenset("._%+-ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins where its first group of digits does: a later start in the
# group fails where the first one failed
_IP_FROM_GROUP = re.compile(r"(?<![0-9])" + IP.pattern)
_IP_RUN = re.compile(r"[0-9.]+")
_CARD_RUN = re.compile(r"[0-9 -]+")
_PHONE_RUN = re.compile(r"[+ ().0-9-]+")
_BACK = {}
for _name, _chars in (("ip", ".0123456789"), ("card", " -0123456789"), ("phone", "+ ().-0123456789")):
    _BACK[_name] = frozenset(_chars)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for d in "0123456789":
        a.add_word(d, ("d", 1))
    for s in SCHEMES:
        a.add_word(s, ("s", len(s)))
    for c in CUES:
        a.add_word(c, ("c", len(c)))
    a.make_automaton()
    return a


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        v = ord(ch) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _good_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _good_card(s: str) -> bool:
    d = s.replace(" ", "").replace("-", "")
    return 14 <= len(d) <= 19 and luhn(d)


def _good_phone(s: str) -> bool:
    return 10 <= sum(ch.isdigit() for ch in s) <= 15


def good_iban(s: str) -> bool:
    """Check digits of an account number: its letters as 10 to 35, the first four moved last, 1 modulo 97."""
    s = s.replace(" ", "").replace("-", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_end(text: str, start: int, end: int) -> int | None:
    """End of the longest valid number from ``start`` that ends with a group, of 34 signs at most."""
    for m in reversed(list(_GROUP_END.finditer(text[start:end]))):
        if good_iban(text[start:start + m.end()]):
            return start + m.end()
    return None


_PARSERS = {
    "ip": (_IP_FROM_GROUP, _IP_RUN, _good_ip),
    "card": (CARD, _CARD_RUN, _good_card), "phone": (PHONE, _PHONE_RUN, _good_phone),
}


def find(text: str | None) -> list[tuple[int, int, int]]:
    """Spans (start, kind number, end) of a text, by start, then kind."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: keep positions
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    out: list[tuple[int, int, int]] = []
    upto = dict.fromkeys(KINDS, 0)  # where the last run or span of a kind ended

    def expand(kind: str, at: int) -> None:
        if at < upto[kind]:
            return
        chars, lo, least = _BACK[kind], at, upto[kind]
        while lo > least and text[lo - 1] in chars:
            lo -= 1
        pattern, run, good = _PARSERS[kind]
        hi = run.match(text, lo).end()
        upto[kind] = hi
        k = KINDS.index(kind)
        for m in pattern.finditer(text, lo, hi):
            if good is None or good(m.group()):
                out.append((m.start(), k, m.end()))

    def email(at: int) -> None:
        lo, upto_last = at, upto["email"]
        while lo > upto_last and text[lo - 1] in _LOCAL:
            lo -= 1
        upto["email"] = at + 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((lo, 0, m.end()))
            upto["email"] = m.end()

    for last, (what, n) in _ANCHORS.iter(low):
        at = last - n + 1
        if what == "d":
            if at >= upto["ip"] and (text[at + 1:at + 2] == "." or text[at - 1:at] == "."):
                expand("ip", at)
            if at >= upto["card"]:
                expand("card", at)
        elif what == "@":
            email(at)
        elif what == "+":
            expand("phone", at)
        elif what == "s":
            if at >= upto["url"] and (m := _URL.match(text, at)):
                end = m.end()
                while text[end - 1] in ".,;:!?":
                    end -= 1
                if end > at + n:
                    out.append((at, 4, end))
                    upto["url"] = end
        elif at >= upto["account"] and not text[max(0, at - 1):at].isalnum():
            if text[last + 1:last + 2].isalnum():
                continue
            if low.startswith("iban", at) and (m := _IBAN.match(text, last + 1)) and (
                    end := _iban_end(text, m.start(2), m.end(2))):
                out.append((m.start(2), 5, end))
                upto["account"] = end
            elif (m := _BEHIND.match(text, last + 1)) and any(c.isdigit() for c in m.group(2)):
                out.append((m.start(2), 5, m.end(2)))
                upto["account"] = m.end(2)
    out.sort()
    return out


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def spans_column(df: DataFrame, text_col: str) -> F.Column:
    """Column: all spans of each whole text, by start, then kind."""
    ship(df.sparkSession)

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t)]
                         for t in texts.to_pylist()], _SPAN_TYPE)

    return spans(F.col(f"`{text_col}`"))


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind; of overlapping spans the
    first (then longest) counts, and what the others add is taken out with it."""
    found = find(text)
    if not found:
        return text
    out, at = [], 0
    for s, k, e in sorted(found, key=lambda x: (x[0], -x[2], x[1])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def mask_column(df: DataFrame, text_col: str) -> F.Column:
    """Column: each whole text with its personal data masked (null stays null)."""
    ship(df.sparkSession)

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([mask(t) for t in texts.to_pylist()], pa.string())

    return masked(F.col(f"`{text_col}`"))
