"""Personal data with offset-preserving deobfuscation.

Base spans come from the text as it stands. For disguised ones the text runs through four
transducers (characters, at/dot disguises of mail addresses, dot disguises of IP addresses, spelled digits). Each is a list of edits with the
source range that every output character stands for; the maps compose, so a span found in
the normalised text goes back to the exact characters of the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from redpen.functions.kernels import kernel

KINDS = ["email", "ip", "card", "phone"]

# ---------------------------------------------------------------- base detectors

# The shapes of personal data. Runs are possessive, and a number starts where its
# run of digits starts, so that long runs cost linear time.
LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY_SIGN = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the run of local characters before it and the domain behind it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            found.append((start, free))
        at = text.find("@", free)
    return found


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) as the text stands, by start and then in the order of KINDS."""
    if not ANY_SIGN.search(text):
        return []
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if 12 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


# ---------------------------------------------------------------- transducers

# Letters of other scripts that look like Latin ones, each followed by its double.
LOOKALIKES = "аaеeоoрpсcуyхxіiѕsјjԁdһhԛqԝwΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧXοoАAВBЕEКKМMНHОOРPСCТTХXІIЅS"
INVISIBLE = "­​‌‍⁠﻿"
AT_WORDS = ["at", "arroba", "klammeraffe", "arobase"]
DOT_WORDS = ["dot", "punkt", "punto", "point"]
PLUS_WORDS = ["plus"]
DIGIT_WORDS = [
    ["zero", "null", "cero", "zéro"],
    ["one", "eins", "uno", "un"],
    ["two", "zwei", "dos", "deux"],
    ["three", "drei", "tres", "trois"],
    ["four", "vier", "cuatro", "quatre"],
    ["five", "fünf", "cinco", "cinq"],
    ["six", "sechs", "seis"],
    ["seven", "sieben", "siete", "sept"],
    ["eight", "acht", "ocho", "huit"],
    ["nine", "neun", "nueve", "neuf"],
]

LATIN = dict(zip(LOOKALIKES[::2], LOOKALIKES[1::2])) | dict.fromkeys(INVISIBLE, "")
VALUE = {word: str(i) for i, words in enumerate(DIGIT_WORDS) for word in words}

# full-width forms, mathematical letters, digits of other scripts, lookalikes, invisible characters
ODD = re.compile("[" + "".join(map(re.escape, LATIN)) + "！-～\U0001d400-\U0001d7ff٠-٩۰-۹०-९①-⑨₀-₉²³¹⁰⁴-⁹]")


def _any(words) -> str:
    return "|".join(sorted(map(re.escape, words), key=len, reverse=True))


_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
AT = re.compile(rf"(?P<framed> {{0,2}}{_OPEN} ?(?:{_any(AT_WORDS)}|@) ?{_CLOSE} {{0,2}})|(?P<sign> {{0,2}}@ {{0,2}})|(?P<bare> (?:{_any(AT_WORDS)}) )", re.I)
LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
DOT = re.compile(rf"(?P<framed> {{0,2}}{_OPEN} ?(?:{_any(DOT_WORDS)}|\.) ?{_CLOSE} {{0,2}})|(?P<bare> (?:{_any(DOT_WORDS)}) )|(?P<sign>\.)", re.I)
_DIGIT = rf"(?:{_any(VALUE)})(?![^\W\d_])"
_JOIN = rf"(?: ?[.-] ?| (?:{_any(DOT_WORDS)}) | )"
SPELLED = re.compile(
    rf"(?<!\w)(?:(?:{_any(PLUS_WORDS)}) |\+ ?)?(?:{_DIGIT}|[0-9]++)(?:{_JOIN}(?:{_DIGIT}|[0-9]++))*", re.I
)
# no run with a word and another unit lacks it
SPELLED_HINT = re.compile(rf"(?<!\w){_DIGIT}{_JOIN}(?:{_DIGIT}|[0-9])|[0-9]{_JOIN}{_DIGIT}|(?<!\w)(?:{_any(PLUS_WORDS)}) [0-9]", re.I)
LEAST_DIGITS = 7
SPELLED_PART = re.compile(rf"(?P<plus>{_any(PLUS_WORDS)}) ?|(?P<digit>{_any(VALUE)})|(?P<dot> ?(?:{_any(DOT_WORDS)}) ?)|(?P<gap> )|(?P<rest>[0-9+.-]+)", re.I)

_DOT = rf"(?: {{0,2}}{_OPEN} ?(?:{_any(DOT_WORDS)}|\.) ?{_CLOSE} {{0,2}}| (?:{_any(DOT_WORDS)}) |\.)"
_GROUP = rf"([0-9]++|{_DIGIT}(?: {_DIGIT}){{0,2}})"
QUAD = re.compile(rf"(?<!\w){_GROUP}({_DOT}){_GROUP}({_DOT}){_GROUP}({_DOT}){_GROUP}", re.I)
# each begins with few characters, so that most texts are passed over quickly
FRAMED_HINT = re.compile(rf"{_OPEN} ?(?:{_any(DOT_WORDS)}|\.) ?{_CLOSE}", re.I)
SPELLED_QUAD_HINT = re.compile(rf"\.(?:{_DIGIT}|(?<=[^\W\d_]\.)[0-9])", re.I)

Edit = tuple[int, int, str]


def character_edits(text: str) -> list[Edit]:
    """Lookalikes, full-width forms and foreign digits as ASCII; invisible characters go."""
    if text.isascii():
        return []
    edits = []
    for m in ODD.finditer(text):
        plain = LATIN.get(m[0])
        if plain is None:
            digit = unicodedata.digit(m[0], None)
            plain = unicodedata.normalize("NFKC", m[0]) if digit is None else str(digit)
        if len(plain) <= 1 and plain.isascii():
            edits.append((m.start(), m.end(), plain))
    return edits


def address_edits(text: str) -> list[Edit]:
    """at and dot disguises that stand between a name, a host and its labels.

    A bare " at " counts only when every dot behind it is disguised as well, so that
    "look at example.com" stays; the last label must then be two or more letters.
    """
    edits, free = [], 0
    for m in AT.finditer(text):
        if m.start() < max(free, 1) or text[m.start() - 1] not in LOCAL:
            continue
        label, dots, disguised, plain = LABEL.match(text, m.end()), [], 0, 0
        while label and (dot := DOT.match(text, label.end())) and (after := LABEL.match(text, dot.end())):
            disguised += dot.lastgroup != "sign"
            plain += dot.lastgroup == "sign"
            dots.append(dot)
            label = after
        hidden_at = m[0] != "@"
        if not dots or not (hidden_at or disguised):
            continue
        if m.lastgroup == "bare" and (plain or not disguised) or disguised and not re.fullmatch("[A-Za-z]{2,24}", label[0]):
            continue
        if hidden_at:
            edits.append((m.start(), m.end(), "@"))
        edits += [(d.start(), d.end(), ".") for d in dots if d.lastgroup != "sign"]
        free = label.end()
    return edits


def quad_edits(text: str) -> list[Edit]:
    """Four groups of digits or spelled digits up to 255 with dots between them, of which some are disguised."""
    edits, at = [], 0
    low = text.lower()
    if not (any(f" {w} " in low for w in DOT_WORDS) or FRAMED_HINT.search(text) or SPELLED_QUAD_HINT.search(text)):
        return edits
    while m := QUAD.search(text, at):
        groups = [m.span(i) for i in (1, 3, 5, 7)]
        values = ["".join(VALUE.get(w, w) for w in text[s:e].lower().split(" ")) for s, e in groups]
        while len(values[3]) > 1 and not _small(values[3]) and " " in text[slice(*groups[3])]:  # words behind the address
            groups[3] = groups[3][0], text.rindex(" ", *groups[3])
            values[3] = values[3][:-1]
        if not all(map(_small, values)):
            at = min(x for x in (text.find(" ", m.start(), m.end(1)), m.end(1)) if x >= 0)
            continue
        for i, (s, e) in enumerate(groups):
            if text[s:e] != values[i]:
                edits.append((s, e, values[i]))
            if i < 3 and m[2 * i + 2] != ".":
                edits.append((*m.span(2 * i + 2), "."))
        at = groups[3][1]
    return edits


def digit_edits(text: str) -> list[Edit]:
    """Runs of seven or more digits of which some, or the plus before them, are words: the words become digits."""
    edits = []
    if not SPELLED_HINT.search(text):
        return edits
    for run in SPELLED.finditer(text):
        if run.end() - run.start() < LEAST_DIGITS:
            continue
        parts = list(SPELLED_PART.finditer(text, run.start(), run.end()))
        if sum(1 if m.lastgroup == "digit" else sum(map(str.isdigit, m[0])) for m in parts) < LEAST_DIGITS:
            continue
        # a word beside an address is not part of its first or last group
        edges = {x for m in IP.finditer(text, run.start(), run.end()) if all(map(_small, m[0].split("."))) for x in m.span()}
        for i, m in enumerate(parts):
            if m.lastgroup == "digit":
                edits.append((m.start(), m.end(), VALUE[m[0].lower()]))
            elif m.lastgroup in ("plus", "dot"):
                edits.append((m.start(), m.end(), "+" if m.lastgroup == "plus" else "."))
            elif m.lastgroup == "gap" and m.end() not in edges and m.start() not in edges and "digit" in (parts[i - 1].lastgroup, parts[min(i + 1, len(parts) - 1)].lastgroup):
                edits.append((m.start(), m.end(), ""))
    return edits


class Traced:
    """A text with the source range that each of its characters stands for.

    ``edits`` are applied to the text; unchanged stretches are kept as offsets, so the map
    takes memory for the edits only.
    """

    def __init__(self, text: str, edits: list[Edit]):
        pieces, kept = [], 0
        self.runs: list[tuple[int, int, bool]] = []  # (source start, source end, edited)
        for start, end, new in edits:
            pieces += [text[kept:start], new]
            self.runs += [(kept, start, False), (start, end, True)]
            kept = end
        pieces.append(text[kept:])
        self.runs.append((kept, len(text), False))
        self.text = "".join(pieces)
        self.ends = list(accumulate(map(len, pieces)))

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source range of text[start:end], and whether an edit lies in it."""
        from bisect import bisect_left, bisect_right

        first, last = bisect_right(self.ends, start), bisect_left(self.ends, end)
        (a, b, changed), (c, d, _) = self.runs[first], self.runs[last]
        begin = a if changed else b - (self.ends[first] - start)
        finish = d if self.runs[last][2] else d - (self.ends[last] - end)
        return begin, finish, any(r[2] for r in self.runs[first : last + 1])


def hidden_spans(text: str) -> list[tuple[int, str, int]]:
    """Spans that show only in the normalised text, as (start, kind, end) in the source."""
    steps = [Traced(text, edits)] if (edits := character_edits(text)) else []
    for rule in (address_edits, quad_edits, digit_edits):
        current = steps[-1].text if steps else text
        if edits := rule(current):
            steps.append(Traced(current, edits))
    found = []
    for start, kind, end in base_spans(steps[-1].text) if steps else []:
        changed = False
        for step in reversed(steps):
            start, end, edited = step.source(start, end)
            changed |= edited
        if changed:
            found.append((start, kind, end))
    return found


def all_spans(text: str) -> list[tuple[int, str, int, bool]]:
    """(start, kind, end, base): base spans, and hidden ones that no base span of their kind holds."""
    base = base_spans(text)
    extra = hidden_spans(text)
    of_kind = {kind: sorted((b[0], b[2]) for b in base if b[1] == kind) for kind in KINDS} if extra else {}

    def held(start: int, kind: str, end: int) -> bool:
        # base spans of a kind do not overlap, so only the last one that starts at or before can hold it
        at = bisect_right(of_kind[kind], (start, len(text))) - 1
        return at >= 0 and end <= of_kind[kind][at][1]

    spans = [(*b, True) for b in base] + [(*x, False) for x in dict.fromkeys(extra) if not held(*x)]
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


# ---------------------------------------------------------------- columns

SPANS = "array<struct<kind: string, start: long, end: long, base: boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _span_rows(texts: pa.Array) -> pa.Array:
    return pa.array(
        [[{"kind": k, "start": s, "end": e, "base": b} for s, k, e, b in all_spans(t or "")] for t in texts.to_pylist()], _ARROW
    )


def personal_spans(text: Column) -> Column:
    """All spans of a text as structs ``kind, start, end, base`` (code points, end exclusive).

    Sorted by start and kind. Null and empty texts have none. Row-local: no shuffle.
    """
    return kernel(SPANS)(_span_rows)(text)


def _redacted(texts: pa.Array) -> pa.Array:
    def one(text: str | None) -> str | None:
        if not text or not (spans := all_spans(text)):
            return text
        out, free = [], 0
        for start, kind, end, _ in spans:
            if start >= free:
                out += [text[free:start], f"[{kind.upper()}]"]
            free = max(free, end)
        return "".join([*out, text[free:]])

    return pa.array(map(one, texts.to_pylist()), pa.string())


def redacted(text: Column) -> Column:
    """The text with every span replaced by its kind; overlapping spans go as one. Null stays null."""
    return kernel("string")(_redacted)(text)


def find_pii(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, personal``: one row per input row; other columns are not read. An empty table gives no rows."""
    return df.select(F.col(key), personal_spans(F.col(text)).alias("personal"))
