"""Column expressions for cleaning, splitting and tokenising text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from redpen.functions.kernels import closed_up_udf, ruled_udf

# Whitespace as Python sees it: the Unicode property plus four control characters.
SPACE = r"[\s\x1c-\x1f]"
SPACES = rf"(?U){SPACE}+"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    Catalyst may move a column's expression into a lambda that uses it, where it would run
    again for every element; a lambda variable stays what it is. Not for columns that go
    into a kernel: its arguments must not hold lambdas that use outer lambda variables.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def tokens(text: Column) -> Column:
    """Whitespace token list without empty entries."""
    return F.filter(F.split(text, SPACES), lambda t: t != "")


def spaced(token_list: Column) -> Column:
    return F.array_join(token_list, " ")


# Edge marks removed after runs are collapsed, in this order.
EDGE_MARKS = [
    rf"(?U)-{SPACE}*\z",
    rf"(?U)\A{SPACE}*-",
    rf"(?U):{SPACE}*\z",
    rf"(?U)\A{SPACE}*:",
    rf"(?U)_{SPACE}*\z",
    rf"(?U)\A{SPACE}*_",
    rf"(?U)~{SPACE}*\z",
    rf"(?U)\A{SPACE}*\.",
]


def cleaned(text: Column) -> Column:
    """Collapse runs of separators, strip marks at the ends, collapse whitespace (no trim)."""
    out = F.translate(text, "\t\r\n", "   ")
    # the six run rules act on different characters, so one back-reference does them all
    out = F.regexp_replace(out, r"([_\-~+.:])\1+", "$1")
    for mark in EDGE_MARKS:
        out = F.regexp_replace(out, mark, "")
    return F.regexp_replace(out, SPACES, " ")


# Treebank-style token rules, applied in order to space-padded text.
# Double quotes stay as they are. `$n` refers to a group.
TREEBANK_RULES = [
    (r"\.\.\.", " ... "),
    (r"[;@#$%&]", " $0 "),
    (r"([:,])([^0-9])", " $1 $2"),
    (r"([:,])$", " $1 "),
    (r"([^.])\.([\])}>\"']*)( |$)", "$1 . $2 "),
    (r"[?!]", " $0 "),
    (r"([^'])' ", "$1 ' "),
    (r"[\]\[(){}<>]", " $0 "),
    (r"--", " -- "),
    (r" ", "  "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r"(?i) (can)(not) ", " $1 $2 "),
    (r"(?i) (d)('ye) ", " $1 $2 "),
    (r"(?i) (gim|lem)(me) ", " $1 $2 "),
    (r"(?i) (gon|wan)(na) ", " $1 $2 "),
    (r"(?i) (got)(ta) ", " $1 $2 "),
    (r"(?i) ('t)(is|was) ", " $1 $2 "),
]


_PARTED = frozenset(["cannot", "gimme", "lemme", "gonna", "wanna", "gotta"])  # words of letters that the rules part


def treebank(text: Column) -> Column:
    """Space-joined Treebank-style tokens."""
    return ruled_udf(TREEBANK_RULES, _PARTED, ".,;:?!")(text)


# Pieces never masked although they are not letters.
KEPT_PIECES = [".", ",", ";", "!", "?", ":", "##.", "##,", "##;", "##!", "##?", "##:"]
SPECIAL_PIECES = ["[CLS]", "[SEP]", "[PAD]", "[UNK]", "[MASK]", "[NUMBER]", "[SYMBOL]"]


def masked_piece(piece: Column) -> Column:
    """Digits become ``[NUMBER]``, other pieces without letters only ``[SYMBOL]``."""
    return (
        F.when(piece.isin(KEPT_PIECES + SPECIAL_PIECES), piece)
        .when(piece.rlike(r"^(\p{Nd}+|##[0-9]*)$"), F.lit("[NUMBER]"))
        .when(piece.rlike(r"^(\p{L}+|##[A-Za-z]+)$"), piece)
        .otherwise(F.lit("[SYMBOL]"))
    )


def strip_separators(text: Column) -> Column:
    return F.regexp_replace(text, " <::::> ", " ")


# Characters whose full upper case is several characters, but which have a single capital.
_GREEK = [chr(c) for c in range(0x1F80, 0x2000) if len(chr(c).upper()) > 1 and len(chr(c).title()) == 1]
CAPITALS = {"\u00df": "\u1e9e"} | {c: c.title() for c in _GREEK}


def _one(cased: Column, letter: Column, single: dict[str, str]) -> Column:
    """The cased letter if it is one character, else its single counterpart, else the letter."""
    return F.when(F.length(cased) == 1, cased).otherwise(F.translate(letter, "".join(single), "".join(single.values())))


def upper_first(text: Column) -> Column:
    """The first character as a capital; it stays one character."""
    first = F.substring(text, 1, 1)
    return F.concat(_one(F.upper(first), first, CAPITALS), _rest(text))


def lower_first(text: Column) -> Column:
    """The first character as a small letter; it stays one character."""
    first = F.substring(text, 1, 1)
    return F.concat(_one(F.lower(first), first, {"\u0130": "i"}), _rest(text))


def _rest(text: Column) -> Column:
    return F.substr(text, F.lit(2))


# Rules that undo the token spacing, applied in order to space-joined tokens.
DETOKENISE_RULES = [
    (r"(?i) ('t) (is|was)\b", " $1$2"),
    (r"(?i)\b(can) (not)\b", "$1$2"),
    (r"(?i)\b(d) ('ye)\b", "$1$2"),
    (r"(?i)\b(gim|lem) (me)\b", "$1$2"),
    (r"(?i)\b(gon|wan) (na)\b", "$1$2"),
    (r"(?i)\b(got) (ta)\b", "$1$2"),
    (r"([^' ]) ('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1$2 "),
    (r"([^' ]) ('[sS]|'[mM]|'[dD]|') ", "$1$2 "),
    (r"^ +| +$", ""),
    (r" -- ", "--"),
    (r"([\[({<]) ", "$1"),
    (r" ([\])}>])", "$1"),
    (r"([\])}>]) ([:;,.])", "$1$2"),
    (r"([^']) ' ", "$1' "),
    (r" ([?!])", "$1"),
    (r"([^.]) (\.)([\])}>\"']*) *$", "$1$2$3"),
    (r"([#$]) ", "$1"),
    (r" ([;%])", "$1"),
    (r" \.\.\. ", "..."),
    (r" ([:,])", "$1"),
]


# the first rules look for word boundaries and stay with Spark's expressions; they are rare, so one search tells whether they are needed
_BOUND = 6
_BOUND_WORDS = r"(?i)('t) (is|was)|(can) (not)|(d) ('ye)|(gim|lem) (me)|(gon|wan) (na)|(got) (ta)"
# Characters one of which every match of the rules after these holds; none for the rule on the ends.
_NEEDS = ["'", "'", "", "-", "[({<", "])}>", "])}>", "'", "?!", ".", "#$", ";%", ".", ":,"]


def detokenised(token_list: Column) -> Column:
    """Running text from tokens: marks, clitics and brackets close up again."""
    plain = F.concat(F.lit(" "), F.array_join(token_list, " "), F.lit(" "))
    out = plain
    for pattern, to in DETOKENISE_RULES[:_BOUND]:
        out = F.regexp_replace(out, pattern, to)
    return closed_up_udf(DETOKENISE_RULES[_BOUND:], _NEEDS)(F.when(plain.rlike(_BOUND_WORDS), out).otherwise(plain))
