"""Personal data by anchor expansion.

One Aho-Corasick pass over the text finds anchors: at-signs, plus signs, digits, scheme
marks and cue words. From each anchor a local parser for the kind walks to the left and to
the right, finds the exact borders and validates what it has found. Parsers are
deterministic and look at the text around their anchor only; an anchor inside a span that
its kind has already taken is skipped.

Base kinds: ``email``, ``ip`` (parts at most 255), ``card`` (12 to 19 digits passing the
Luhn test), ``phone`` (international, 9 to 15 digits). Added kinds: ``login`` (an address
with user information before the host), ``account`` (a cue such as IBAN or SSN followed by
a number that passes the cue's test, in any letter case) and ``address`` (house number,
capitalised name and a street word, in the order of four languages).
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SPANS, count_kind, free_name, map_batches, span_array, struct_text, texts

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "login", "account", "address"]
_ORDER = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[A-Za-z0-9._%+~-]+(?::[^\s:@/]*)?@[A-Za-z0-9.-]*[A-Za-z0-9](?::[0-9]+)?(?:/[^\s<>\"']*[A-Za-z0-9/])?")
_LEAD = re.compile(r"(?:[ -]?(?:number|nummer|num[ée]ro|n[úu]mero|no\.?|num\.?|nr\.?|n[°º]|n\.[°º]))?[ ]?[:=#]?[ ]?", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}(-?)[0-9]{2}\1[0-9]{4}(?![0-9])")
#: Six to twelve capitals and digits, three of them digits.
_MIXED = re.compile(r"(?=(?:[A-Z]*[0-9]){3})[A-Z0-9]{6,12}(?![A-Za-z0-9])")
_PLAIN = re.compile(r"[A-Z]{0,3}[0-9](?:[ -]?[0-9]){5,16}(?![A-Za-z0-9])")
#: Cue (English, German, French, Spanish) -> the test of what follows. Cues are found in any letter case.
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "plain", "acct": "plain", "passport": "passport",
        "konto": "plain", "kontonummer": "plain", "reisepass": "passport", "reisepassnummer": "passport", "compte": "plain", "passeport": "passport", "cuenta": "plain", "pasaporte": "passport"}
#: Street words after the names (English), at the end of a name (German), before the names with the number first (French) or last (Spanish).
STREETS = ["Street", "Avenue", "Road", "Boulevard", "Lane", "Drive", "Court", "Square", "Place", "Terrace", "Parkway", "Highway", "St", "Ave", "Rd", "Blvd", "Ln", "Dr", "Ct", "Sq", "Pl", "Pkwy", "Hwy"]
GERMAN = ["straße", "strasse", "str.", "weg", "platz", "allee", "gasse"]
FRENCH = ["rue", "avenue", "av.", "boulevard", "bd", "place", "chemin", "impasse", "quai"]
SPANISH = ["calle", "avenida", "avda.", "paseo", "plaza", "carretera"]
#: House number, one to six names, and the space before an English street word.
_HOUSE = re.compile(r"[0-9]{1,5}[A-Za-z]?(?: [A-Z][a-z]+){1,6} $")
_NAMES = r"(?: (?:de|des|du|la|las|le|les|los|del|l'|d'))* ?(?:[dl]['’])?[A-ZÀ-Þ][\w'’-]*(?:(?: (?:de|des|du|la|las|le|les|los|del))* [A-ZÀ-Þ][\w'’-]*){0,3}"
_NUMBER_LAST = re.compile(r" [0-9]{1,4}(?: ?[a-z])?(?!\w)")
_GERMAN_NAME = re.compile(r"(?:[A-ZÄÖÜ][\wß]*[ -]){0,2}[A-ZÄÖÜ][\wß]*[ -]?$")
_FRENCH_NUMBER = re.compile(r"(?<!\w)[0-9]{1,4}(?: ?(?:bis|ter))?,? $")
_FRENCH_NAMES = re.compile(_NAMES)
_SPANISH_NAMES = re.compile(_NAMES + r",?(?: n[.º°]+)? [0-9]{1,4}(?!\w)")


def _automaton() -> ahocorasick.Automaton:
    """Anchors in lower case, for texts in lower case."""
    words = {"@": "email", "+": "phone", "://": "login"} | {d: "digit" for d in "0123456789"} | CUES
    words |= {f" {s.lower()}": "address" for s in STREETS}
    words |= {f"{s} ": "german" for s in GERMAN} | {f" {s} ": "french" for s in FRENCH} | {f"{s} ": "spanish" for s in SPANISH}
    found = ahocorasick.Automaton()
    for word, kind in words.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _lower(text: str) -> str:
    """Lower case with the same offsets; only characters that would become several are left."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _words_before(text: str, at: int, count: int, marks: str = " ") -> int:
    """Where the last ``count`` words before a place begin, however long they are."""
    for _ in range(count):
        at = max(text.rfind(m, 0, at) for m in marks)
        if at < 0:
            return 0
    return at + 1


def _address(text: str, kind: str, at: int, end: int) -> tuple[int, int] | None:
    """The address around a street word."""
    if kind == "address":
        if not text[at + 1].isupper() or not _bounded(text, at + 1, end):
            return None
        found = _HOUSE.search(text, _words_before(text, at, 7), at + 1)
        return (found.start(), end) if found and _bounded(text, found.start(), end) else None
    if kind == "german":  # the anchor ends with a space
        last = _NUMBER_LAST.match(text, end - 1)
        found = last and _GERMAN_NAME.search(text, _words_before(text, at, 4, " -\n"), at)
        return (found.start(), last.end()) if found and last and _bounded(text, found.start(), last.end()) else None
    if kind == "french":
        found, last = _FRENCH_NUMBER.search(text, max(0, at - 12), at + 1), _FRENCH_NAMES.match(text, end - 1)
        return (found.start(), last.end()) if found and last else None
    last = _SPANISH_NAMES.match(text, end - 1)
    return (at, last.end()) if last and _bounded(text, at, last.end()) else None


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _bounded(text: str, start: int, end: int) -> bool:
    return (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())


def _account(text: str, kind: str, start: int, end: int) -> tuple[int, int] | None:
    """The number that follows a cue, if it passes the cue's test."""
    if not _bounded(text, start, end):
        return None
    at = _LEAD.match(text, end).end()
    if kind == "iban":
        found = _IBAN.match(text, at)
        # the longest valid number: spaces between groups may run into the next word
        while found and not (iban_valid(found[0]) and _bounded(text, found.start(), found.end())):
            found = _IBAN.match(text, at, found.end() - 1)
    else:
        found = (_SSN if kind == "ssn" else _PLAIN).match(text, at)
        if kind == "passport" and not found:
            found = _MIXED.match(text, at)
    return found.span() if found else None


def find(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then by kind; base kinds never overlap within a kind."""
    spans, after, quad, card = [], dict.fromkeys(KINDS, 0), 0, 0
    for last, (kind, length) in automaton.iter(_lower(text)):
        at = last - length + 1
        if kind == "digit":
            if at >= quad:  # the first digit of a run is the only start of its dotted quad
                found = _QUAD.match(text, at)
                if found:
                    quad = found.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found[0].split(".")):
                        spans.append(("ip", at, quad))
                else:
                    quad = _DIGITS.match(text, at).end()
            if at >= card:
                found = _CARD.match(text, at)
                card = found.end() if found else at + 1
                if found:
                    digits = found[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        spans.append(("card", at, card))
        elif kind == "email":
            start = at
            while start > after["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (found := _DOMAIN.match(text, at + 1)):
                spans.append(("email", start, found.end()))
                after["email"] = found.end()
        elif kind == "phone":
            if found := _PHONE.match(text, at):
                if 9 <= sum(c in "0123456789" for c in found[0]) <= 15:
                    spans.append(("phone", at, found.end()))
        elif kind == "login":
            start = at
            while start > after["login"] and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and text[start].isalpha() and (found := _LOGIN.match(text, at)):
                spans.append(("login", start, found.end()))
                after["login"] = found.end()
        elif kind in ("address", "german", "french", "spanish"):
            if (found := _address(text, kind, at, last + 1)) and found[0] >= after["address"]:
                spans.append(("address", *found))
                after["address"] = found[1]
        elif (found := _account(text, kind, at, last + 1)) and found[0] >= after["account"]:
            spans.append(("account", *found))
            after["account"] = found[1]
    spans.sort(key=lambda s: (s[1], _ORDER[s[0]]))
    return spans


def annotate(docs: DataFrame, text_column: str = "text", spans_column: str = "spans", mask: bool = False) -> DataFrame:
    """Adds the spans (code points, end exclusive) of each whole text; with ``mask`` the text is replaced too.

    Masking writes ``[kind]`` over each stretch of overlapping spans, naming its first kind;
    a null text stays null and has no spans. All columns pass through; if ``spans_column``
    is taken, a free name is used.
    """
    name = free_name(docs, spans_column)
    place = docs.columns.index(text_column)

    def make():
        automaton = _automaton()

        def step(batch):
            rows = [find(t, automaton) for t in texts(batch, place)]
            columns = list(batch.columns)
            if mask:
                old = columns[place].to_pylist()
                columns[place] = pa.array([masked(t, s) if s else t for t, s in zip(old, rows, strict=True)], pa.string())
            return pa.RecordBatch.from_arrays([*columns, span_array(rows)], names=[*batch.schema.names, name])
        return step

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{name}` {SPANS}"])
    return map_batches(docs, make, schema)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], f"[{kind}]"]
        at, k = end, k + 1
    return "".join(out) + text[at:]


def mask_texts(docs: DataFrame, text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """``docs`` with personal data masked in its texts and, if there is such a column, the length brought up to date.

    Documents without a span come back as they are.
    """
    spans = free_name(docs, "spans")
    out = annotate(docs, text_column, spans, mask=True)
    if length_column in docs.columns:
        kind = docs.schema[length_column].dataType
        out = out.withColumn(length_column, F.when(F.size(spans) > 0, F.length(text_column).cast(kind)).otherwise(F.col(length_column)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts and digest of the base spans and the list of all spans, one row per document.

    Null and empty texts have no spans, repeated rows give repeated results, spans that start
    together are listed in the order of kinds, an empty table gives an empty result, and
    other columns are not read.
    """
    rows = annotate(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")))
    counts = [count_kind("spans", k).alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(struct_text("spans", BASE), 256).alias("base_sha256"), struct_text("spans").alias("spans"))
