"""Personal data: identifiers in plain sight, and disguised ones found in a normalised text and mapped back.

A transducer rewrites a text piece by piece (look-alike characters, spelled digits, "at" and "dot" in words) and
keeps, for each character it writes, the span of the source it came from. The same detectors run over both texts.

Offsets are code points, ends exclusive. Null counts as the empty text and has no spans. Detectors are linear in the
text, so a very long one is a longer row. Repeated rows get equal results. Plain spans of one kind never overlap; a
span found without disguises may hold plain ones, and spans of two kinds may overlap. An empty table gives no rows. Other
columns pass through or stay out, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a run of digits that fails from its start fails from every later digit too
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: Look-alikes of Latin letters and signs, beside what compatibility normalisation already folds.
_CYRILLIC = dict(zip("абвдезіјкмнорсстухуёАВЕЅІЈКМНОРСТУХѕһԁԛԝ", "a6bdeeijkmhopcctyxyeABESIJKMHOPCTYXshdqw"))
_GREEK = dict(zip("αεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeikvoptuxABEZHIKMNOPTYX"))
_SIGNS = dict(zip("‐‑‒–—−⁃․。·•∙﹒﹫", "-------.......@"))
_ALIKE = {**_CYRILLIC, **_GREEK, **_SIGNS}
_UNSEEN = frozenset("­​‌‍⁠﻿")
_ODD = re.compile(r"[^\x00-\xac\xae-\xb1\xb4-ɏḀ-ỿ]")

_DIGITS = {w: d for d, names in enumerate(("zero oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")) for w in names.split()}
_NUMBER = "|".join(sorted(_DIGITS, key=len, reverse=True))
_OPEN, _CLOSE = r"[\(\[\{<]", r"[\)\]\}>]"
_AT, _DOT = r"(?:at|arroba|arobase)", r"(?:dot|punkt|punto|point)"
_LABEL = r"[A-Za-z0-9-]+"
_TOP = r"[A-Za-z]{2,}"
_ANY_DOT = rf"(?:\.|[ ]?{_OPEN}[ ]?{_DOT}[ ]?{_CLOSE}[ ]?|[ ]dot[ ])"
_RULES = re.compile(
    rf"""(?P<at>(?<=[A-Za-z0-9])[ ]*{_OPEN}[ ]*(?:{_AT}|@)[ ]*{_CLOSE}[ ]*(?=[A-Za-z0-9]))
    |(?P<bareat>(?<=[A-Za-z0-9])[ ]at[ ](?=(?:{_LABEL}\.)*{_LABEL}(?:[ ]?{_OPEN}[ ]?{_DOT}[ ]?{_CLOSE}[ ]?|[ ]dot[ ]){_LABEL}))
    |(?P<namedat>(?<=[A-Za-z0-9])[ ]at[ ](?=(?:{_LABEL}\.)+{_TOP}(?![A-Za-z0-9-])))
    |(?P<spacedat>(?<=[A-Za-z0-9])(?:[ ]@[ ]?|@[ ])(?={_LABEL}{_ANY_DOT}{_LABEL}))
    |(?P<dot>(?<=[A-Za-z0-9])[ ]*{_OPEN}[ ]*(?:{_DOT}|\.)[ ]*{_CLOSE}[ ]*(?=[A-Za-z0-9]))
    |(?P<baredot>(?<=[A-Za-z0-9])[ ]dot[ ](?=[A-Za-z0-9]))
    |(?P<plus>\bplus[ ](?=(?:{_NUMBER})\b|[0-9]))
    |(?P<digit>(?<![A-Za-z])(?:{_NUMBER})(?![A-Za-z])(?:[ -](?=(?:{_NUMBER})(?![A-Za-z])))?)
    |(?P<zero>(?<=[0-9])[Oo](?=[0-9]))
    |(?P<one>(?<=[0-9])[lI](?=[0-9]))""",
    re.X | re.I,
)
_SPELLED = re.compile(rf"(?<![A-Za-z])(?:{_NUMBER})(?![A-Za-z])[ ,.-]*(?:dot[ ])?(?:(?:{_NUMBER})(?![A-Za-z])|[0-9])|[0-9][ ,.-]*(?:{_NUMBER})(?![A-Za-z])", re.I)
_BRACKET = re.compile(rf"{_OPEN}[ ]*(?:{_AT}|{_DOT}|@|\.)[ ]*{_CLOSE}", re.I)
_NAMED = re.compile(rf"[A-Za-z0-9] at (?:{_LABEL}\.)+{_TOP}(?![A-Za-z0-9-])", re.I)
#: Signs of a local part that no word of prose has.
_TELLING = re.compile("[0-9._%+-]")
_MIXED = re.compile(r"[0-9][OolI][0-9]")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: an address starts where the run of local characters before its @ starts."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Identifiers in plain sight, by kind and place."""
    found = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def disguised(text: str) -> bool:
    """Whether the transducer could write anything else than the text."""
    if not text.isascii() and _ODD.search(text):
        return True
    low = text.lower()
    if ("at" in low or "dot" in low or "@" in low) and (" dot " in low or " @" in low or "@ " in low or _BRACKET.search(text) or " at " in low and _NAMED.search(text)):
        return True
    return _SPELLED.search(text) is not None or _MIXED.search(text) is not None


def _fold(text: str) -> tuple[str, list[int] | None]:
    """Look-alikes replaced; for each character written, the place it came from (None: every character kept its place)."""
    if text.isascii() or not _ODD.search(text):
        return text, None
    out, at = [], []
    for i, c in enumerate(text):
        if c in _UNSEEN:
            continue
        if c > "\xac" and _ODD.match(c):
            c = _ALIKE.get(c) or unicodedata.normalize("NFKC", c)
        for x in c:
            out.append(x)
            at.append(i)
    return "".join(out), at


def normalise(text: str) -> tuple[str, list[int], list[int]]:
    """The text without disguises; the source span (start, end) behind each of its characters."""
    folded, at = _fold(text)
    place = at if at is not None else range(len(folded))
    out, starts, ends = [], [], []
    # of the run of local characters that ends what is written: its length, whether it tells a local part, or has a spelled digit
    run, telling, spelled = 0, False, False

    def write(said: str, a: int, b: int, digit: bool = False) -> None:
        nonlocal run, telling, spelled
        out.append(said)
        new = len(said)
        while new and said[new - 1] in _LOCAL:
            new -= 1
        if new:
            run, telling, spelled = 0, False, False
        run += len(said) - new
        spelled |= digit
        telling |= not digit and _TELLING.search(said, new) is not None
        if len(said) == b - a:
            starts.extend(place[a:b])
            ends.extend(x + 1 for x in place[a:b])
        else:
            starts.extend([place[a]] * len(said))
            ends.extend([place[b - 1] + 1] * len(said))

    done = 0
    for m in _RULES.finditer(folded):
        kind = m.lastgroup
        if done < m.start():
            write(folded[done : m.start()], done, m.start())
            done = m.start()
        # a spelled digit tells nothing when it is the whole local part ("the one at example.com")
        if kind == "namedat" and not (telling or spelled and run > 1):
            continue
        said = "@" if kind in ("at", "bareat", "namedat", "spacedat") else "." if kind in ("dot", "baredot") else "+" if kind == "plus" else "0" if kind == "zero" else "1" if kind == "one" else str(_DIGITS[m[0].rstrip(" -").lower()])
        write(said, m.start(), m.end(), kind == "digit")
        done = m.end()
    if done < len(folded):
        write(folded[done:], done, len(folded))
    return "".join(out), starts, ends


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, spans only found without disguises), each by start and kind."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    plain = sorted(detect(text), key=order)
    added: list[Span] = []
    if disguised(text):
        clear, starts, ends = normalise(text)
        for kind, a, b in detect(clear):
            span = (kind, starts[a], ends[b - 1])
            if not any(k == kind and x <= span[1] and span[2] <= y for k, x, y in plain):
                added.append(span)
    return plain, sorted(added, key=order)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first in brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, few at a time, as each text is held as a Python string."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.slice(a, rows)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("plain", pa.bool_())]))


def find_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and spans: array of (kind, start, stop, plain), by start and then kind."""
    one = F.struct(F.lit("").alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"), F.lit(True).alias("plain"))
    schema = docs.select(*keep, F.array(one).alias("spans")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            rows = []
            for t in batch.column(len(keep)).to_pylist():
                plain, added = find(t or "")
                both = sorted([(*s, True) for s in plain] + [(*s, False) for s in added], key=lambda s: (s[1], KINDS.index(s[0])))
                rows.append([dict(zip(("kind", "start", "stop", "plain"), s)) for s in both])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(rows, _SPANS)], [*keep, "spans"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, with the spans of ``text`` blotted out; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            k = batch.schema.names.index("text")
            texts = [t if t is None else redacted(t, [s for part in find(t) for s in part]) for t in batch.column(k).to_pylist()]
            yield batch.set_column(k, "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
