"""Row kernels for steps that are sequential within one row. All run as Arrow batches."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import Counter
from itertools import accumulate
from math import isqrt
from operator import xor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F


def kernel(kind: str):
    """An Arrow function that Catalyst keeps in one place.

    A filter or an explode over its result would otherwise copy the call below itself and
    run the kernel twice; functions marked as not deterministic are never copied.
    """
    return lambda function: F.arrow_udf(function, kind).asNondeterministic()


# ---------------------------------------------------------------- edited copies

# Words put in place of dropped ones, by a hex digit.
INSERTS = ["and", "or", "but", "so"]
_INSERT_AT = {d: INSERTS[0 if d < "8" else 1 if d < "c" else 2 if d < "e" else 3] for d in "0123456789abcdef"}


def place_hashes(key: int, n: int) -> list[str]:
    """The md5 of ``7:key:place`` of each place as hex text."""
    head = f"7:{key}:"
    return [hashlib.md5(f"{head}{i}".encode()).hexdigest() for i in range(n)]


def edited_tokens(toks: list[str], hashes: list[str], slot: int) -> list[tuple[str, bool]]:
    """About 3/16 of the tokens deleted and 1/16 replaced, by the two hex digits from ``slot`` on (from 1): token, whether new."""
    at = slot - 1
    return [(_INSERT_AT[h[slot]], True) if h[at] == "3" else (t, False) for t, h in zip(toks, hashes) if h[at] not in "012"]


def edits_udf(slot: int):
    """Tokens and key -> the edited copy as structs of token and whether it is new."""

    @kernel("array<struct<t:string,new:boolean>>")
    def edits(toks: pa.Array, key: pa.Array) -> pa.Array:
        texts, news, sizes = [], [], [0]
        for own, k in zip(toks.to_pylist(), key.to_pylist()):
            for t, new in edited_tokens(own, place_hashes(k, len(own)), slot) if own and k is not None else ():
                texts.append(t)
                news.append(new)
            sizes.append(len(texts))
        made = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(news, pa.bool_())], ["t", "new"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), made)

    return edits


def edited_text(toks: list[str], hashes: list[str], slot: int) -> str:
    """The edited copy as text."""
    at = slot - 1
    return " ".join([_INSERT_AT[h[slot]] if h[at] == "3" else t for t, h in zip(toks, hashes) if h[at] not in "012"])


def edited_texts_udf(slots: list[int]):
    """Text and key -> the text with single spaces and one edited copy per slot; the hashes are made once for all."""

    @kernel("array<string>")
    def texts(text: pa.Array, key: pa.Array) -> pa.Array:
        out = []
        for own, k in zip(text.to_pylist(), key.to_pylist()):
            toks = (own or "").split()
            hashes = place_hashes(k, len(toks)) if slots and k is not None else []
            out.append(" ".join(toks))
            out += [edited_text(toks, hashes, slot) for slot in slots]
        width = len(slots) + 1
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, width).astype(np.int32)), pa.array(out, pa.string()))

    return texts


def _halves(text: str) -> tuple[list[str], list[str]]:
    toks = text.split()
    middle = -(-len(toks) // 2)
    return toks[:middle], toks[middle:]


def halves_udf():
    """Text -> the text cut into one or two sources in the middle."""

    @kernel("array<string>")
    def cut(text: pa.Array) -> pa.Array:
        halves, sizes = [], [0]
        for own in text.to_pylist():
            one, two = _halves(own)
            halves += [" ".join(part) for part in ((one, two) if two else (one,))]
            sizes.append(len(halves))
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(halves, pa.string()))

    return cut


def halves_target_udf(slot: int):
    """Text and key -> an edited copy that may start with the second half."""

    @kernel("string")
    def target(text: pa.Array, key: pa.Array) -> pa.Array:
        out = []
        for own, k in zip(text.to_pylist(), key.to_pylist()):
            one, two = _halves(own)
            order = two + one if hashlib.md5(f"5:{k}".encode()).hexdigest()[0] < "8" else one + two
            out.append(edited_text(order, place_hashes(k, len(order)), slot))
        return pa.array(out, pa.string())

    return target


def dealt_udf(seed: int, values: list[str], swap_seed: int | None = None):
    """Text and key -> its tokens and one value per token by the first hex digit of a hash; a swap mark may end the first half."""
    assert len(values) == 16

    @kernel("struct<tokens:array<string>,tags:array<string>>")
    def deal(text: pa.Array, key: pa.Array) -> pa.Array:
        tokens, tags, sizes = [], [], [0]
        for own, k in zip(text.to_pylist(), key.to_pylist()):
            toks, head = own.split(), f"{seed}:{k}:".encode()
            drawn = [values[hashlib.md5(b"%b%d" % (head, i)).digest()[0] >> 4] for i in range(len(toks))]
            if swap_seed is not None and len(toks) > 1 and hashlib.md5(f"{swap_seed}:{k}".encode()).hexdigest()[0] < "8":
                drawn[-(-len(toks) // 2) - 1] = "SWAP"
            tokens += toks
            tags += drawn
            sizes.append(len(tokens))
        offsets = pa.array(sizes, pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(c, pa.string())) for c in (tokens, tags)], ["tokens", "tags"])

    return deal


def counted_values_udf(seed: int, values: list[str]):
    """Text and key -> its tokens and one value per token, by the first four hex digits of a hash."""

    @kernel("struct<tokens:array<string>,tags:array<string>>")
    def deal(text: pa.Array, key: pa.Array) -> pa.Array:
        tokens, tags, sizes = [], [], [0]
        for own, k in zip(text.to_pylist(), key.to_pylist()):
            toks, head = own.split(), f"{seed}:{k}:".encode()
            tokens += toks
            tags += [values[int.from_bytes(hashlib.md5(b"%b%d" % (head, i)).digest()[:2]) % len(values)] for i in range(len(toks))]
            sizes.append(len(tokens))
        offsets = pa.array(sizes, pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(c, pa.string())) for c in (tokens, tags)], ["tokens", "tags"])

    return deal


# ---------------------------------------------------------------- token rules

def rule_patterns(rules: list[tuple[str, str]]) -> list[tuple[re.Pattern, str]]:
    """Rules of Java's form for Python; without regard to case means ASCII letters."""
    return [(re.compile(pattern, re.ASCII), re.sub(r"\$(\d)", r"\\g<\1>", to)) for pattern, to in rules]


def ruled_udf(rules: list[tuple[str, str]], parted: frozenset[str], closing: str):
    """Text -> its words with the rules applied to the space-padded text, single spaces between what they part.

    No rule looks further than the spaces around a word, except to see a full stop or an apostrophe behind a space. So words are
    remembered with what the rules make of them, and only texts in which a word starts with one of these two marks are taken whole.
    Words of letters and digits stay as they are unless they are in ``parted``, and lose one of the marks ``closing`` behind them.
    """
    patterns = rule_patterns(rules)
    memo: dict[str, str] = {}

    def ruled(words: list[str]) -> str:
        out = f" {' '.join(words)} "
        for pattern, to in patterns:
            out = pattern.sub(to, out)
        return " ".join([w for w in out.split(" ") if w])

    def whole(text: str) -> str:
        words = text.split()
        try:
            return " ".join([memo[w] for w in words])
        except KeyError:
            if any(w[0] in ".'" for w in words):
                return ruled(words)
            if len(memo) > MEMO_SIZE:
                memo.clear()
            for w in words:
                if w not in memo:
                    stem, mark = (w[:-1], f" {w[-1]}") if w[-1] in closing else (w, "")
                    memo[w] = stem + mark if stem.isalnum() and stem.lower() not in parted else ruled([w])
            return " ".join([memo[w] for w in words])

    @kernel("string")
    def apply(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else whole(t) for t in text.to_pylist()], pa.string())

    return apply


def closed_up_udf(rules: list[tuple[str, str]], needs: list[str]):
    """Text -> the text after the rules; a rule is only tried where one of its characters in ``needs`` occurs, one without them is about the ends."""
    patterns = list(zip(rule_patterns(rules), needs))

    @kernel("string")
    def apply(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            if t is not None:
                there = set(t)
                for (pattern, to), marks in patterns:
                    if not marks:
                        t = t.strip(" ")
                    elif not there.isdisjoint(marks):
                        t = pattern.sub(to, t)
                t = t.strip(" ")
            out.append(t)
        return pa.array(out, pa.string())

    return apply


# ---------------------------------------------------------------- sari

def gram_sets(toks: list[str]) -> list[set]:
    """The distinct n-grams of one to four tokens."""
    return [set(toks), set(zip(toks, toks[1:])), set(zip(toks, toks[1:], toks[2:])), set(zip(toks, toks[1:], toks[2:], toks[3:]))]


def _share(part: int, whole: int) -> float:
    return part / whole if whole > 0 else 1.0


def _f1(precision: float, recall: float) -> float:
    return 2 * precision * recall / (precision + recall) if precision > 0 and recall > 0 else 0.0


def sari_scores(source: list[set], targets: list[list[set]], predictions: list[list[set]]) -> list[tuple[float, float, float]]:
    """(keep, addition, deletion) of each prediction from the gram sets of the texts.

    A gram's weight is the share of non-empty targets that hold it; counts are scaled by the number of targets, so
    they stay whole numbers.
    """
    sums = [[0.0, 0.0, 0.0] for _ in predictions]
    for n, s in enumerate(source):
        lists = [t[n] for t in targets if t[n]]
        scale = max(len(lists), 1)
        in_s = sum(len(s & t) for t in lists)
        new = set().union(*lists) - s
        for total, prediction in zip(sums, predictions):
            p = prediction[n]
            sp = s & p
            both = sum(len(sp & t) for t in lists)
            hit = len(new & p)
            gone = len(s) - len(sp)
            total[0] += _f1(_share(both, len(sp) * scale), _share(both, in_s))
            total[1] += _f1(_share(hit, len(p) - len(sp)), _share(hit, len(new)))
            total[2] += _f1(
                _share(gone * scale - (in_s - both), gone * scale), _share(gone * scale - (in_s - both), len(s) * scale - in_s)
            )
    return [tuple(x / 4 for x in total) for total in sums]


def sari_udf():
    """Source, targets and predictions -> (keep, addition, deletion) per prediction. Grams of a text are made once."""

    @kernel("array<struct<keep:double,addition:double,deletion:double>>")
    def score(source: pa.Array, targets: pa.Array, predictions: pa.Array) -> pa.Array:
        out, sizes = [], [0]
        for s, ts, ps in zip(source.to_pylist(), targets.to_pylist(), predictions.to_pylist()):
            if s is not None and ts is not None:
                made = [[gram_sets((t or "").split()) for t in texts or []] for texts in ([s], ts, ps)]
                out += sari_scores(made[0][0], *made[1:])
            else:
                out += [(None, None, None)] * len(ps or [])
            sizes.append(len(out))
        parts = [pa.array(c, pa.float64()) for c in (zip(*out) if out else [[], [], []])]
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(parts, ["keep", "addition", "deletion"]))

    return score


# ---------------------------------------------------------------- token counts

def counted_tokens(batches):
    """Batches of texts -> their whitespace tokens with counts, each once per batch."""
    for batch in batches:
        counts = Counter()
        for text in batch.column(0):
            counts.update((text.as_py() or "").split())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])


# ---------------------------------------------------------------- added phrases

def lcs_tokens(source: list[str], target: list[str]) -> list[str]:
    """One longest common subsequence, preferring the step that shortens the source.

    Column j of the dynamic-programming table is kept as the bits where the value grows
    from one source token to the next; a whole column is updated by a few operations on
    one long integer. The walk back only needs these growth bits, and rebuilds them block
    by block, so memory grows with the square root of the target length.
    """
    full = (1 << len(source)) - 1
    where: dict[str, int] = {}
    for i, token in enumerate(source):
        where[token] = where.get(token, 0) | (1 << i)

    def after(flat: int, token: str) -> int:
        hit = flat & where.get(token, 0)
        return ((flat + hit) | (flat - hit)) & full

    width = isqrt(len(target)) + 1
    block_starts = []
    flat = full
    for j, token in enumerate(target):
        if j % width == 0:
            block_starts.append(flat)
        flat = after(flat, token)

    kept = []
    i, j = len(source), len(target)
    while i and j:
        block = (j - 1) // width
        flat, grows = block_starts[block], []
        for token in target[block * width : j]:
            flat = after(flat, token)
            grows.append(full & ~flat)
        while i and j > block * width:
            if source[i - 1] == target[j - 1]:
                kept.append(target[j - 1])
                i -= 1
                j -= 1
            elif grows[j - 1 - block * width] >> (i - 1) & 1:
                j -= 1
            else:
                i -= 1
    kept.reverse()
    return kept


def added_phrases(source: str, target: str) -> list[str]:
    """Runs of target tokens left over when the common tokens take their first match."""
    wanted = target.lower().split()
    common = iter(lcs_tokens(source.lower().split(), wanted))
    awaited = next(common, None)
    runs: list[list[str]] = [[]]
    for token in wanted:
        if token == awaited:
            awaited = next(common, None)
            runs.append([])
        else:
            runs[-1].append(token)
    return [" ".join(run) for run in runs if run]


def fewest_added_phrases(sources: list[str], target: str, try_swap: bool) -> list[str]:
    best = added_phrases(" ".join(sources), target)
    if try_swap and len(sources) == 2:
        other = added_phrases(f"{sources[1]} {sources[0]}", target)
        if sum(map(len, other)) < sum(map(len, best)):
            return other
    return best


def added_phrases_udf(try_swap: bool):
    @kernel("array<string>")
    def mine(sources: pa.Array, target: pa.Array) -> pa.Array:
        rows = zip(sources.to_pylist(), target.to_pylist())
        return pa.array(
            [None if s is None or t is None else fewest_added_phrases(s, t, try_swap) for s, t in rows],
            pa.list_(pa.string()),
        )

    return mine


# ---------------------------------------------------------------- edit tags

class Tagger:
    """Greedy rewriting of a target as one edit per source token."""

    def __init__(self, phrases):
        self.phrases = {p.lower() for p in phrases}
        self.longest = max((len(p.split()) for p in self.phrases), default=0)

    def in_order(self, source: list[str], target: list[str]) -> list[tuple[str, str]]:
        """(type, phrase) per token, or an empty list when the target cannot be reached."""
        edits = [("DELETE", "")] * len(source)
        done = 0
        deleted_from = 0  # start of the run of deletions before the current token
        for at, token in enumerate(source):
            if done == len(target):
                break
            added = self._phrase_before(token, target, done)
            if added is None:
                continue
            edits[at] = ("KEEP", "")
            if added:
                slot = deleted_from if deleted_from < at else at
                edits[slot] = (edits[slot][0], " ".join(target[done : done + added]))
            done += added + 1
            deleted_from = at + 1
        return edits if done == len(target) else []

    def _phrase_before(self, token: str, target: list[str], done: int) -> int | None:
        """Length of the shortest known phrase after which ``token`` follows; None if there is none."""
        if target[done] == token:
            return 0
        for n in range(1, min(self.longest, len(target) - done - 1) + 1):
            if target[done + n] == token and " ".join(target[done : done + n]) in self.phrases:
                return n
        return None

    def tags(self, sources: list[str], target: str, do_swap: bool) -> tuple[list[str], bool]:
        parts = [text.lower().split() for text in sources]
        wanted = target.lower().split()
        edits = self.in_order([t for part in parts for t in part], wanted)
        swapped = False
        if not edits and do_swap and len(parts) == 2:
            edits = self.in_order(parts[1] + parts[0], wanted)
            if edits:
                swapped = True
                second = len(parts[1])
                edits = edits[second:] + edits[:second]
                last = len(parts[0]) - 1
                edits[last] = ("SWAP", edits[last][1])
        return [f"{kind}|{phrase}" if phrase else kind for kind, phrase in edits], swapped


def tags_udf(phrases, do_swap: bool):
    """``phrases`` is a broadcast variable holding the phrase list."""
    out = pa.struct([("tags", pa.list_(pa.string())), ("swapped", pa.bool_())])
    made: list[Tagger] = []  # one per task

    @kernel("struct<tags:array<string>,swapped:boolean>")
    def tag(sources: pa.Array, target: pa.Array) -> pa.Array:
        if not made:
            made.append(Tagger(phrases.value))
        tagger = made[0]
        rows = []
        for s, t in zip(sources.to_pylist(), target.to_pylist()):
            tags, swapped = ([], False) if s is None or t is None else tagger.tags(s, t, do_swap)
            rows.append({"tags": tags, "swapped": swapped})
        return pa.array(rows, out)

    return tag


def row_tags_udf(do_swap: bool):
    """Sources, target and the phrases known among the spans of the target -> tags."""
    out = pa.struct([("tags", pa.list_(pa.string())), ("swapped", pa.bool_())])

    @kernel("struct<tags:array<string>,swapped:boolean>")
    def tag(sources: pa.Array, target: pa.Array, phrases: pa.Array) -> pa.Array:
        rows = []
        for s, t, known in zip(sources.to_pylist(), target.to_pylist(), phrases.to_pylist()):
            tags, swapped = ([], False) if s is None or t is None else Tagger(known).tags(s, t, do_swap)
            rows.append({"tags": tags, "swapped": swapped})
        return pa.array(rows, out)

    return tag


# ---------------------------------------------------------------- word pieces

def _is_cjk(ch: str) -> bool:
    # Blocks of CJK ideographs.
    c = ord(ch)
    return (
        0x4E00 <= c <= 0x9FFF
        or 0x3400 <= c <= 0x4DBF
        or 0x20000 <= c <= 0x2A6DF
        or 0x2A700 <= c <= 0x2B73F
        or 0x2B740 <= c <= 0x2B81F
        or 0x2B820 <= c <= 0x2CEAF
        or 0xF900 <= c <= 0xFAFF
        or 0x2F800 <= c <= 0x2FA1F
    )


def _is_punctuation(ch: str) -> bool:
    ascii_mark = "!" <= ch <= "/" or ":" <= ch <= "@" or "[" <= ch <= "`" or "{" <= ch <= "~"
    return ascii_mark or unicodedata.category(ch).startswith("P")


class _Characters(dict):
    """What to put in place of a character, asked once per character; for ``str.translate``."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, code: int) -> str:
        made = self[code] = self.of(chr(code))
        return made


def _plain(ch: str) -> str:
    if ch in "\t\n\r" or unicodedata.category(ch) == "Zs":
        return " "
    if ch in "\x00�" or unicodedata.category(ch) in ("Cc", "Cf"):
        return ""
    return f" {ch} " if _is_cjk(ch) else ch


_PLAIN = _Characters(_plain)
_UNMARKED = _Characters(lambda ch: "" if unicodedata.category(ch) == "Mn" else ch)
_PARTS = _Characters(lambda ch: f" {ch} " if _is_punctuation(ch) else ch)
_ASCII_PARTS = _Characters(lambda ch: _PARTS[ord(ch)] if _PLAIN[ord(ch)] == ch else _PLAIN[ord(ch)])
_FOLDED_PARTS = _Characters(lambda ch: _PARTS[ord(ch)] if _UNMARKED[ord(ch)] else "")


def basic_tokens(text: str, lower: bool = True) -> list[str]:
    """Drop control characters, isolate ideographs and punctuation, fold case and accents."""
    if text.isascii():
        return [text.lower() if lower else text] if text.isalnum() else (text.lower() if lower else text).translate(_ASCII_PARTS).split()
    if text.isalnum() and max(text) < "\u2e80":  # plain words need no splitting
        if not lower:
            return [text]
        folded = text.lower()
        if folded.isascii():
            return [folded]
        folded = unicodedata.normalize("NFD", folded).translate(_UNMARKED)
        return [folded] if folded else []
    out = text.translate(_PLAIN)
    if lower:
        return unicodedata.normalize("NFD", out.lower()).translate(_FOLDED_PARTS).split()
    return out.translate(_PARTS).split()


LONGEST_WORD = 200  # characters; a longer word is unknown


def word_pieces(word: str, vocab, longest: int = LONGEST_WORD) -> list[str]:
    """Longest known prefix first; a word with an unknown rest is ``[UNK]`` as a whole."""
    if len(word) > longest:
        return ["[UNK]"]
    pieces = []
    at = 0
    while at < len(word):
        mark = "##" if at else ""
        end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in vocab), None)
        if end is None:
            return ["[UNK]"]
        pieces.append(mark + word[at:end])
        at = end
    return pieces


MEMO_SIZE = 200_000  # tokens a task remembers from one batch to the next


class PieceTable:
    """The pieces of a vocabulary by their texts, at the start of a word and inside, with the lengths to try, long ones first, by the first two characters."""

    def __init__(self, known):
        # words share the texts of their pieces
        self.first = self._sized({piece: piece for piece in known if piece})
        self.rest = self._sized({piece[2:]: piece for piece in known if piece.startswith("##") and len(piece) > 2})

    @staticmethod
    def _sized(pieces: dict[str, str]) -> tuple[dict, dict, bool]:
        found: dict[str, set] = {}
        for text in pieces:
            found.setdefault(text[:2], set()).add(len(text))
        # a piece of one character stands for all words that begin with it
        return pieces, {start: sorted(n - {1}, reverse=True) for start, n in found.items()}, all(len(text) == 1 for text in pieces)

    def pieces(self, word: str) -> list[str]:
        """``word_pieces``, of which only lengths are tried that some piece with these first characters has."""
        size = len(word)
        if size > LONGEST_WORD:
            return ["[UNK]"]
        out, at = [], 0
        pieces, lengths, single = *self.first[:2], False
        try:
            while at < size:
                if single:
                    return out + [pieces[ch] for ch in word[at:]]
                for n in lengths.get(word[at : at + 2], ()):
                    if n <= size - at and (piece := pieces.get(word[at : at + n])) is not None:
                        break
                else:
                    piece, n = pieces[word[at]], 1
                out.append(piece)
                at += n
                pieces, lengths, single = self.rest
        except KeyError:
            return ["[UNK]"]
        return out


class WordCutter:
    """Words -> their pieces, of which only the first ones that are asked for are made. ``vocab`` is a broadcast dict of ids.

    A word is cut once per task, up to a fixed number of remembered words.
    """

    def __init__(self, vocab, lower: bool):
        self.vocab, self.lower, self.table = vocab, lower, None
        self.memo: dict[str, tuple[str, ...]] = {}

    def of_word(self, word: str) -> tuple[str, ...]:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > MEMO_SIZE:
                self.memo.clear()
            if self.table is None:
                self.table = PieceTable(self.vocab.value)
            found = self.memo[word] = tuple([p for part in basic_tokens(word, self.lower) for p in self.table.pieces(part)] if word else [])
        return found

    def first(self, words: list[str], room: int | None = None) -> list[str]:
        """The first ``room`` pieces of the words, or all."""
        out, memo = [], self.memo
        for word in words:
            out += memo[word] if word in memo else self.of_word(word)
            if room is not None and len(out) >= room:
                return out[:room]
        return out

    def spread(self, words: list[str], values: list, room: int | None = None) -> list | None:
        """The value of a word over each of its pieces; words without a value give null, values without a word a null row."""
        if len(values) > len(words):
            return None
        out = []
        for at, word in enumerate(words):
            out += [values[at] if at < len(values) else None] * len(self.of_word(word))
            if room is not None and len(out) >= room:
                return out[:room]
        return out


def token_cutter(vocab, lower: bool):
    """Tokens (Arrow) -> lists of word pieces; ``vocab`` is a broadcast set.

    Batches are dictionary-encoded, so a token is cut once however often it occurs, and
    the task remembers the tokens of earlier batches up to a fixed number.
    """
    cutter = WordCutter(vocab, lower)

    def cut(tokens: pa.Array) -> pa.Array:
        coded = pc.dictionary_encode(tokens)
        pieces = [cutter.of_word(token) for token in coded.dictionary.to_pylist()]
        return pa.array(pieces, pa.list_(pa.string())).take(coded.indices)

    return cut


def pieces_udf(vocab, lower: bool = True):
    """Token list -> one list of word pieces per token."""
    cut = token_cutter(vocab, lower)

    @kernel("array<array<string>>")
    def pieces(token_lists: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(_offsets(token_lists), cut(token_lists.flatten()))

    return pieces


def sentence_pieces_udf(vocab, lower: bool = True):
    """Sentences as token lists -> the same sentences as flat piece lists."""

    cut = token_cutter(vocab, lower)

    @kernel("array<array<string>>")
    def pieces(documents: pa.Array) -> pa.Array:
        sentences = documents.flatten()
        tokens = cut(sentences.flatten())
        token_at = _offsets(sentences).to_numpy()
        piece_at = _offsets(tokens).to_numpy()[token_at]
        pieced = pa.ListArray.from_arrays(pa.array(piece_at), tokens.flatten())
        return pa.ListArray.from_arrays(_offsets(documents), pieced)

    return pieces


def _offsets(lists: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def starts_udf():
    """Pieces per token -> position of each token's first piece, counted from 1."""

    @kernel("array<int>")
    def starts(pieces: pa.Array) -> pa.Array:
        per_row = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(pieces.flatten()), 0).to_numpy(zero_copy_only=False)
        before = np.cumsum(sizes, dtype=np.int64) - sizes
        row_ends = np.cumsum(per_row, dtype=np.int64)
        row_starts = row_ends - per_row
        base = np.concatenate([before, [0]])[np.minimum(row_starts, len(before))]
        values = (before - np.repeat(base, per_row) + 1).astype(np.int32)
        return pa.ListArray.from_arrays(_offsets(pieces), pa.array(values))

    return starts


def toggled_udf(marks: list[str]):
    """Pieces -> 0/1 per piece: parity of the marks before it in its row, by running sums over the batch."""

    @kernel("array<int>")
    def toggled(pieces: pa.Array) -> pa.Array:
        hits = pc.fill_null(pc.is_in(pieces.flatten(), pa.array(marks)), False).to_numpy(zero_copy_only=False)
        before = np.cumsum(hits) - hits
        sizes = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
        row_starts = np.cumsum(sizes, dtype=np.int64) - sizes
        base = np.concatenate([before, [0]])[np.minimum(row_starts, len(before))]
        values = ((before - np.repeat(base, sizes)) % 2).astype(np.int32)
        return pa.ListArray.from_arrays(_offsets(pieces), pa.array(values))

    return toggled


def basic_tokens_udf(lower: bool = True):
    @kernel("array<string>")
    def cut(text: pa.Array) -> pa.Array:
        return pa.array(
            [None if t is None else basic_tokens(t, lower) for t in text.to_pylist()], pa.list_(pa.string())
        )

    return cut


def _arrow_type(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow_type(kind[6:-1]))
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[kind]


def look_up_udf(table, kind: str, default=None):
    """Lists of entries -> lists of values through a broadcast dict; an unknown entry is ``default``, or an error without one."""
    kept = _arrow_type(kind)

    @kernel(f"array<{kind}>")
    def look_up(entries: pa.Array) -> pa.Array:
        known = table.value
        coded = pc.dictionary_encode(entries.flatten())
        keys = coded.dictionary.to_pylist()
        distinct = pa.array([known[e] for e in keys] if default is None else [known.get(e, default) for e in keys], kept)
        return pa.ListArray.from_arrays(_offsets(entries), distinct.take(coded.indices))

    return look_up


def found_udf(kind: str, default=None):
    """Lists of entries -> lists of values through the keys and values that come with each row."""
    kept = _arrow_type(kind)

    @kernel(f"array<{kind}>")
    def look_up(entries: pa.Array, keys: pa.Array, values: pa.Array) -> pa.Array:
        out = []
        for asked, own_keys, own_values in zip(entries.to_pylist(), keys.to_pylist(), values.to_pylist()):
            known = dict(zip(own_keys, own_values))
            out.append([known[e] for e in asked or []] if default is None else [known.get(e, default) for e in asked or []])
        return pa.array(out, pa.list_(kept))

    return look_up


class KeyFilter:
    """Tells for the CRC of a text whether it may be a key; ``bitmap`` is a broadcast variable of a power of two of bits."""

    def __init__(self, bitmap):
        self.words = bitmap.value
        self.mask = 64 * len(self.words) - 1

    def may_hold(self, crc: int) -> bool:
        place = crc & self.mask
        return bool(int(self.words[place >> 6]) >> (place & 63) & 1)


def spans_udf(bitmap, longest: int):
    """Sources and target -> the spans of target tokens that may be phrases and end before a token of the sources.

    These are all spans that the tagger can ask for, in either order of the sources.
    """
    made: list[KeyFilter] = []

    def spans(sources: list[str], target: str) -> list[str]:
        kept = {t for text in sources for t in text.lower().split()}
        wanted = target.lower().split()
        found = {}
        for at in range(len(wanted)):
            crc = 0
            for end in range(at + 1, min(at + longest, len(wanted) - 1) + 1):
                crc = zlib.crc32((wanted[end - 1] if end == at + 1 else f" {wanted[end - 1]}").encode(), crc)
                if wanted[end] in kept and made[0].may_hold(crc):
                    found[" ".join(wanted[at:end])] = None
        return list(found)

    @kernel("array<string>")
    def ask(sources: pa.Array, target: pa.Array) -> pa.Array:
        if not made:
            made.append(KeyFilter(bitmap))
        rows = zip(sources.to_pylist(), target.to_pylist())
        return pa.array([[] if s is None or t is None else spans(s, t) for s, t in rows], pa.list_(pa.string()))

    return ask


def substrings_udf(bitmap, longest: int, lower: bool):
    """Token -> the pieces of its words that may be in the vocabulary."""
    made: list[KeyFilter] = []

    def pieces(token: str) -> list[str]:
        found = {}
        for word in basic_tokens(token, lower):
            for at in range(len(word) if len(word) <= LONGEST_WORD else 0):
                crc = zlib.crc32(b"##") if at else 0
                for end in range(at + 1, min(at + longest, len(word)) + 1):
                    crc = zlib.crc32(word[end - 1].encode("utf-8", "surrogatepass"), crc)
                    if made[0].may_hold(crc):
                        found[("##" if at else "") + word[at:end]] = None
        return list(found)

    @kernel("array<string>")
    def ask(tokens: pa.Array) -> pa.Array:
        if not made:
            made.append(KeyFilter(bitmap))
        return pa.array([pieces(t) for t in tokens.to_pylist()], pa.list_(pa.string()))

    return ask


def cut_udf(lower: bool):
    """Token and the known pieces of its words -> its pieces."""

    @kernel("array<string>")
    def cut(tokens: pa.Array, known: pa.Array) -> pa.Array:
        rows = zip(tokens.to_pylist(), known.to_pylist())
        return pa.array([[p for word in basic_tokens(t, lower) for p in word_pieces(word, frozenset(k))] for t, k in rows], pa.list_(pa.string()))

    return cut


# ---------------------------------------------------------------- feature rows

def _rows(lists: pa.Array) -> list[list[str] | None]:
    """Lists of texts as Python lists. The texts are converted in one go, which takes a tenth of the time of ``to_pylist``."""
    texts, at = lists.flatten().to_numpy(zero_copy_only=False).tolist(), _offsets(lists).to_pylist()
    rows = [texts[a:b] for a, b in zip(at, at[1:])]
    return [row if valid else None for row, valid in zip(rows, lists.is_valid().to_pylist())] if lists.null_count else rows


def _word_lists(column: pa.Array) -> list[list[str]]:
    """The words of texts or of token lists; null has none."""
    if pa.types.is_list(column.type):
        return [words or [] for words in _rows(column)]
    return [(text or "").split() for text in column.to_pylist()]


def _lists(rows: list[list | None], kind: str) -> pa.Array:
    sizes = np.cumsum([0] + [len(r or ()) for r in rows]).astype(np.int32)
    mask = pa.array([r is None for r in rows]) if None in rows else None
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array([x for r in rows for x in r or ()], _arrow_type(kind)), mask=mask)


def flat_pieces_udf(vocab, lower: bool):
    """Text or tokens -> all pieces in one list."""
    cutter = WordCutter(vocab, lower)

    @kernel("array<string>")
    def pieces(words: pa.Array) -> pa.Array:
        return _lists([cutter.first(own) for own in _word_lists(words)], "string")

    return pieces


def piece_text_udf(vocab, lower: bool):
    """Text or tokens -> all pieces as text with single spaces."""
    cutter = WordCutter(vocab, lower)

    @kernel("string")
    def pieces(words: pa.Array) -> pa.Array:
        return pa.array([" ".join(cutter.first(own)) for own in _word_lists(words)], pa.string())

    return pieces


ID_FIELDS = "input_ids:array<{0}>,input_mask:array<int>,segment_ids:array<int>"


def _id_columns(rows: list[tuple[list, list]], length: int, pad, kind: str) -> list[pa.Array]:
    """Ids and segments -> ids, mask and segments, filled up to ``length``."""
    fill = [length - len(ids) for ids, _ in rows]
    return [
        _lists([ids + [pad] * n for (ids, _), n in zip(rows, fill)], kind),
        _lists([[1] * len(ids) + [0] * n for (ids, _), n in zip(rows, fill)], "int"),
        _lists([segments + [0] * n for (_, segments), n in zip(rows, fill)], "int"),
    ]


def _toggled(pieces: list[str], toggles: frozenset) -> list[int]:
    """The parity of the toggling pieces before each one."""
    if toggles.isdisjoint(pieces):
        return [0] * len(pieces)
    return list(accumulate([p in toggles for p in pieces], xor, initial=0))[:-1]


def id_rows_udf(vocab, lower: bool, length: int, pad, kind: str):
    """Text -> ids of ``[CLS] pieces [SEP]``, mask and segments."""
    cutter = WordCutter(vocab, lower)

    @kernel(f"struct<{ID_FIELDS.format(kind)}>")
    def features(words: pa.Array) -> pa.Array:
        known, rows = vocab.value, []
        for own in _word_lists(words):
            ids = [known["[CLS]"], *[known[p] for p in cutter.first(own, length - 2)], known["[SEP]"]]
            rows.append((ids, [0] * len(ids)))
        return pa.StructArray.from_arrays(_id_columns(rows, length, pad, kind), ["input_ids", "input_mask", "segment_ids"])

    return features


def edit_rows_udf(vocab, lower: bool, length: int, pad, kind: str, marks: list[str], labels=None, label_kind: str = "int", starts: str | None = None):
    """Tokens, and tags if there are labels -> ids of ``[CLS] pieces [SEP]``, mask and segments, which toggle behind each of the ``marks``.

    With ``labels``, a broadcast dict of the ids of tags, also the labels of the pieces and their mask; with ``starts`` the position
    of each token's first piece; "row_starts" tells for tokens behind the row only that they are.
    """
    cutter, toggles, room = WordCutter(vocab, lower), frozenset(marks), length - 2
    fields = ID_FIELDS.format(kind) + (f",labels:array<{label_kind}>,labels_mask:array<int>" if labels is not None else "")
    fields += ",token_starts:array<int>" if starts else ""

    def framed(rows: list[list | None]) -> list[list | None]:
        return [None if r is None else [0, *r, *[0] * (length - 1 - len(r))] for r in rows]

    def positions(words: list[str]) -> list[int]:
        out, at = [], 1
        for word in words:
            out.append(at)
            if starts == "token_starts" or at < length:
                at += len(cutter.of_word(word))
        return out

    def rows_of(words: pa.Array, tags: pa.Array | None) -> pa.Array:
        known, rows, word_lists = vocab.value, [], _word_lists(words)
        for own in word_lists:
            pieces = cutter.first(own, room)
            rows.append(([known["[CLS]"], *[known[p] for p in pieces], known["[SEP]"]], [0, *_toggled(pieces, toggles), 0]))
        columns = _id_columns(rows, length, pad, kind)
        if labels is not None:
            ids = labels.value
            spread = [cutter.spread(own, [ids[t] for t in asked or []], room) for own, asked in zip(word_lists, _rows(tags))]
            columns += [_lists(framed(spread), label_kind), _lists(framed([None if r is None else [1] * len(r) for r in spread]), "int")]
        if starts:
            columns.append(_lists([positions(own) for own in word_lists], "int"))
        return pa.StructArray.from_arrays(columns, [f.split(":")[0] for f in fields.split(",")])

    if labels is None:

        @kernel(f"struct<{fields}>")
        def features(words: pa.Array) -> pa.Array:
            return rows_of(words, None)

    else:

        @kernel(f"struct<{fields}>")
        def features(words: pa.Array, tags: pa.Array) -> pa.Array:
            return rows_of(words, tags)

    return features


def fitted(a: int, b: int, room: int) -> tuple[int, int]:
    """Lengths after shortening the longer one (the second on ties) until both fit."""
    return min(a, max(-(-room // 2), room - b)), min(b, max(room // 2, room - a))


def pair_rows_udf(vocab, lower: bool, length: int, kind: str):
    """Two texts -> ids of ``[CLS] a [SEP] b [SEP]``, mask and segments; without a second text the first has all the room."""
    cutter, room = WordCutter(vocab, lower), length - 3

    @kernel(f"struct<{ID_FIELDS.format(kind)}>")
    def features(text_a: pa.Array, text_b: pa.Array) -> pa.Array:
        known, rows = vocab.value, []
        for one, two in zip(_word_lists(text_a), _word_lists(text_b)):
            a, b = cutter.first(one, room + 1), cutter.first(two, room)
            if b:
                keep_a, keep_b = fitted(len(a), len(b), room)
                a, b = a[:keep_a], [*b[:keep_b], "[SEP]"]
            rows.append(([known[p] for p in ("[CLS]", *a, "[SEP]", *b)], [0] * (len(a) + 2) + [1] * len(b)))
        return pa.StructArray.from_arrays(_id_columns(rows, length, 0, kind), ["input_ids", "input_mask", "segment_ids"])

    return features


def spread_ids_udf(vocab, lower: bool, table: dict, default: int, length: int | None = None, first: int = 0, last: int = 0):
    """Tokens and tags -> the id of a tag over the pieces of its token, framed and filled up to ``length`` if there is one.

    ``table`` is small; a tag that is not in it is ``default``.
    """
    cutter = WordCutter(vocab, lower)
    room = None if length is None else length - 2

    @kernel("array<int>")
    def spread(words: pa.Array, tags: pa.Array) -> pa.Array:
        rows = [cutter.spread(own, [table.get(t, default) for t in asked or []], room) for own, asked in zip(_word_lists(words), _rows(tags))]
        if length is not None:
            rows = [None if r is None else [first, *r, last, *[0] * (room - len(r))] for r in rows]
        return _lists(rows, "int")

    return spread


def parts_udf():
    """Sources and a tag per token -> the texts that the tags make of the first and the second source, and whether they change places."""
    memo: dict[str, tuple[str, bool]] = {}

    def made(tag: str | None) -> tuple[str, bool]:
        """The phrase of a tag, and whether its token stays; a missing tag drops the token."""
        if tag not in memo:
            if len(memo) > MEMO_SIZE:
                memo.clear()
            kind, _, phrase = (tag or "").partition("|")
            memo[tag] = phrase, tag is not None and kind != "DELETE"
        return memo[tag]

    def joined(words: list[str], tags: list[str]) -> str:
        out = []
        for word, tag in zip(words, tags):
            phrase, stays = made(tag)
            if phrase:
                out.append(phrase)
            if stays:
                out.append(word)
        return " ".join(out)

    @kernel("struct<a:string,b:string,swap:boolean>")
    def parts(sources: pa.Array, tags: pa.Array) -> pa.Array:
        rows = []
        for own, row_tags in zip(_rows(sources), _rows(tags)):
            lists = [text.split() for text in own]
            words = [w for part in lists for w in part]
            if row_tags is None or len(words) != len(row_tags):
                raise ValueError(f"number of tags {len(row_tags or [])} differs from number of tokens {len(words)}")
            second = len(lists[0]) if len(lists) == 2 else len(words)
            swap = len(lists) == 2 and second > 0 and (row_tags[second - 1] or "").partition("|")[0] == "SWAP"
            rows.append((joined(words[:second], row_tags[:second]), joined(words[second:], row_tags[second:]), swap))
        columns = list(zip(*rows)) if rows else [[], [], []]
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_())], ["a", "b", "swap"])

    return parts


# ---------------------------------------------------------------- sentence packing

def _uniform(*parts) -> float:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2.0**32


def pack(sizes: list[int], key, max_tokens: int, short_prob: float, seed: int) -> list[dict]:
    """Chunk boundaries over the sentences of one document, from their token counts alone."""
    goal = max_tokens
    if _uniform(seed, key, "short") < short_prob:
        goal = 2 + int(_uniform(seed, key, "goal") * (max_tokens - 1))
    chunks = []
    first = 0
    while first < len(sizes):
        end, held = first, 0
        while end < len(sizes) and held < goal:
            held += sizes[end]
            end += 1
        count = end - first
        cut = 1 if count == 1 else 1 + int(_uniform(seed, key, first, "cut") * (count - 1))
        random_next = count == 1 or _uniform(seed, key, first, "next") < 0.5
        chunks.append({
            "first": first,
            "cut": first + cut,
            "last": end,
            "is_random_next": random_next,
            "wanted": goal - sum(sizes[first : first + cut]),
        })
        first = first + cut if random_next else end
    return chunks


PACK_TYPE = "array<struct<first:int,a:array<string>,b:array<string>,is_random_next:boolean,wanted:int>>"


def _ranges(pieces: pa.Array, starts: np.ndarray, ends: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Lists of the pieces from each start to its end; null where not valid."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    taken = pieces.take(pa.array(np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])))
    mask = None if valid is None else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), taken, mask=mask)


def pack_udf(max_tokens: int, short_prob: float, seed: int):
    """Sentences as piece lists, and the name of the document -> its chunks with their pieces.

    Boundaries come from the sentence lengths; the pieces of all chunks of a batch are then taken at once.
    """

    @kernel(PACK_TYPE)
    def chunks(sentences: pa.Array, key: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False)
        row_at = np.cumsum(sizes) - sizes
        flat = sentences.flatten()
        lengths = pc.fill_null(pc.list_value_length(flat), 0).to_numpy(zero_copy_only=False)
        piece_at = np.concatenate([[0], np.cumsum(lengths)])
        found, per_row, base = [], [], []
        for at, n, name in zip(row_at.tolist(), sizes.tolist(), key.to_pylist()):
            own = pack(lengths[at : at + n].tolist(), name, max_tokens, short_prob, seed)
            found += own
            per_row.append(len(own))
            base += [at] * len(own)
        base = np.array(base, np.int64)
        first, cut, last = (base + np.array([c[k] for c in found], np.int64) for k in ("first", "cut", "last"))
        random_next = np.array([c["is_random_next"] for c in found], bool)
        pieces = flat.flatten()
        fields = [
            pa.array([c["first"] for c in found], pa.int32()), _ranges(pieces, piece_at[first], piece_at[cut]),
            _ranges(pieces, piece_at[cut], np.where(random_next, piece_at[cut], piece_at[last]), ~random_next),
            pa.array(random_next), pa.array([c["wanted"] for c in found], pa.int32()),
        ]
        made = pa.StructArray.from_arrays(fields, ["first", "a", "b", "is_random_next", "wanted"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), made)

    return chunks


WINDOW_ROWS = 1 << 12  # windows of one Arrow batch
CUT_ROWS = 1 << 8  # documents whose windows are laid out at a time


def served(win: np.ndarray, windows: np.ndarray, size: np.ndarray, room: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flags of all positions of all windows, positions per window): whether no other window serves the position better."""
    start = win.astype(np.int64) * step
    length = np.minimum(room, size - start)
    row = np.repeat(np.arange(len(win)), length)
    at = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length) + start[row]
    room, step, size, last = room[row], step[row], size[row], np.minimum(at // step[row], windows[row] - 1)

    def score(of: np.ndarray) -> np.ndarray:
        begin = of * step
        held = np.minimum(room, size - begin)
        return np.minimum(at - begin, begin + held - 1 - at) + 0.01 * held

    own_win = win[row]
    own, best = score(own_win), np.ones(len(row), bool)
    other = np.maximum(-((room - 1 - at) // step), 0)  # the first window that reaches the place
    while (left := other <= last).any():
        theirs = score(other)
        best &= ~left | np.where(other < own_win, theirs < own, theirs <= own)
        other = other + 1
    return best, length


def served_udf():
    """Number of a window, number of windows, size, room and step of its document -> a flag per position."""

    @kernel("array<boolean>")
    def flags(win: pa.Array, windows: pa.Array, size: pa.Array, room: pa.Array, step: pa.Array) -> pa.Array:
        best, length = served(*[c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (win, windows, size, room, step)])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(best))

    return flags


def cut_windows(max_len: int, stride: int, max_query: int, cut_tokens=None):
    """Batches of documents (their other columns, then pieces per word, words, query) -> batches of windows.

    A window holds its own pieces and words only, so long documents are not carried along to each of their windows.
    With a token cutter, tokens come instead of the pieces and the query, and each window has its flags of ``served``.
    """
    names = ["win", "start", "length", "query_len", "doc_size", "room", "step", "n_windows"]

    def of(batch: pa.RecordBatch):
        pieces, words, query = batch.columns[-3:]
        if cut_tokens is not None:
            pieces = pa.ListArray.from_arrays(_offsets(pieces), cut_tokens(pieces.flatten()))
            asked = cut_tokens(query.flatten())
            query = pa.ListArray.from_arrays(pa.array(_offsets(asked).to_numpy()[_offsets(query).to_numpy()]), asked.flatten())
        per_doc = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        per_word = pc.fill_null(pc.list_value_length(pieces.flatten()), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, word = pieces.flatten().flatten(), words.flatten()
        word_at, piece_at = (np.concatenate([[0], np.cumsum(n)]) for n in (per_doc, per_word))
        word_of = np.repeat(np.arange(len(per_word)), per_word)
        size = np.diff(piece_at[word_at])
        query_len = np.minimum(pc.fill_null(pc.list_value_length(query), 0).to_numpy(zero_copy_only=False), max_query).astype(np.int64)
        query_at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(query), 0).to_numpy(zero_copy_only=False))])[:-1]
        asked = query.flatten()
        room = max_len - 3 - query_len
        step = np.minimum(room, stride)
        windows = np.where(size > 0, np.maximum(-((room - size) // step), 0) + 1, 0)
        ends = np.cumsum(windows)
        for low in range(0, int(ends[-1]) if len(ends) else 0, WINDOW_ROWS):
            at = np.arange(low, min(low + WINDOW_ROWS, int(ends[-1])))
            doc = np.searchsorted(ends, at, "right")
            win = at - (ends - windows)[doc]
            start = win * step[doc]
            length = np.minimum(room[doc], size[doc] - start)
            first = piece_at[word_at[doc]] + start
            from_word, to_word = word_of[first], word_of[first + length - 1] + 1
            places = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
            relative = (word_of[places] - np.repeat(from_word, length)).astype(np.int32)
            bounds = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
            numbers = [win, start, length, query_len[doc], size[doc], room[doc], step[doc], windows[doc]]
            columns = [
                *[c.take(pa.array(doc)) for c in batch.columns[:-3]], *[pa.array(n.astype(np.int32)) for n in numbers],
                _ranges(flat, first, first + length), pa.ListArray.from_arrays(bounds, pa.array(relative)),
                _ranges(word, from_word, to_word), _ranges(asked, query_at[doc], query_at[doc] + query_len[doc]),
            ]
            out = [*batch.schema.names[:-3], *names, "window", "word_of", "words", "query"]
            if cut_tokens is not None:
                columns.append(pa.ListArray.from_arrays(bounds, pa.array(served(win, windows[doc], size[doc], room[doc], step[doc])[0])))
                out.append("is_max_context")
            yield pa.RecordBatch.from_arrays(columns, out)

    def cut(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, CUT_ROWS):
                yield from of(batch.slice(low, CUT_ROWS))

    return cut


def whole_word_order(pieces: list[str], key: str, limit: int) -> list[int]:
    """Positions chosen for masking when all pieces of a word go together."""
    words: list[list[int]] = []
    for at, piece in enumerate(pieces):
        if piece in ("[CLS]", "[SEP]"):
            continue
        if words and piece.startswith("##"):
            words[-1].append(at)
        else:
            words.append([at])
    words.sort(key=lambda w: hashlib.md5(f"{key}:{w[0]}".encode()).hexdigest())
    chosen: list[int] = []
    for word in words:
        if len(chosen) + len(word) <= limit:
            chosen.extend(word)
    return sorted(chosen)


def whole_word_udf():
    @kernel("array<int>")
    def choose(pieces: pa.Array, key: pa.Array, limit: pa.Array) -> pa.Array:
        rows = zip(_rows(pieces), key.to_pylist(), limit.to_pylist())
        return pa.array([whole_word_order(p, k, n) for p, k, n in rows], pa.list_(pa.int32()))

    return choose


def truncated_udf(room: int, seed: int):
    """Two piece lists and a key -> both shortened until they fit, each surplus piece taken from the front or back by hash."""

    def cut(pieces: list[str], keep: int, name: str, key: str | None) -> list[str]:
        head = f"{seed}:{key}:{name}:"
        surplus = len(pieces) - keep if key is not None else 0
        front = sum(hashlib.md5(f"{head}{j}".encode()).hexdigest()[0] < "8" for j in range(1, surplus + 1))
        return pieces[front : front + keep]

    @kernel("struct<a:array<string>,b:array<string>>")
    def truncate(a: pa.Array, b: pa.Array, key: pa.Array) -> pa.Array:
        first, second = [], []
        for one, two, k in zip(_rows(a), _rows(b), key.to_pylist()):
            # a missing side takes no room from the other's half, and gives none
            keep_a, keep_b = fitted(room if one is None else len(one), room if two is None else len(two), room)
            first.append(None if one is None else cut(one, keep_a, "a", k))
            second.append(None if two is None else cut(two, keep_b, "b", k))
        return pa.StructArray.from_arrays([_lists(first, "string"), _lists(second, "string")], ["a", "b"])

    return truncate


def masked_udf(words, n_words: int, seed: int, whole_word: bool):
    """Tokens, key and number -> tokens with as many masked, their positions and what was there.

    ``words`` is a broadcast dict of the words that stand in for some of them, by number; None if there are none.
    """
    framing = ("[CLS]", "[SEP]")

    def chosen(tokens: list[str], key: str, limit: int) -> list[int]:
        if whole_word:
            return whole_word_order(tokens, f"{seed}:{key}", limit)
        head = f"{seed}:{key}:"
        usable = sorted((hashlib.md5(f"{head}{i}".encode()).digest(), i) for i, t in enumerate(tokens) if t not in framing)
        return sorted(i for _, i in usable[:limit])

    def shown(token: str, key: str, at: int) -> str:
        kind = _uniform(seed, key, at, "kind")
        if kind < 0.8:
            return "[MASK]"
        if kind < 0.9:
            return token
        return "[MASK]" if words is None else words.value[int(_uniform(seed, key, at, "word") * n_words)]

    @kernel("struct<tokens:array<string>,places:array<int>,labels:array<string>>")
    def mask(tokens: pa.Array, key: pa.Array, limit: pa.Array) -> pa.Array:
        masked, places, labels = [], [], []
        for own, k, n in zip(_rows(tokens), key.to_pylist(), limit.to_pylist()):
            at = None if own is None else chosen(own, k, n)
            labels.append(None if own is None else [own[i] for i in at])
            for i in at or []:
                own[i] = shown(own[i], k, i)
            masked.append(own)
            places.append(at)
        columns = [_lists(masked, "string"), _lists(places, "int"), _lists(labels, "string")]
        return pa.StructArray.from_arrays(columns, ["tokens", "places", "labels"])

    return mask


# ---------------------------------------------------------------- prediction repair

# Marks of which only the first in a run stays, quotes, and the pairs that must close.
RUN_MARKS = frozenset(",.:!?")
QUOTES = frozenset("\"'")
PAIRS = ["{}", "[]", "()"]


_PARTNERED = {*QUOTES, *"".join(PAIRS)}


def repaired_tokens(words: list[str]) -> list[str]:
    """Drop quotes, leading and repeated marks, and every bracket without a partner or closed before the first word.

    Brackets are judged by their running balance: a closing one has a partner if the balance does not reach a new
    low, an opening one if the balance falls below its own level later on.
    """
    present = set(words)
    if present.isdisjoint(_PARTNERED):  # marks only, or none
        if present.isdisjoint(RUN_MARKS):
            return words
        kept, begun, after = [], False, False
        for w in words:
            mark = w in RUN_MARKS
            if not mark or (begun and not after):
                kept.append(w)
            begun, after = begun or not mark, mark
        return kept
    n = len(words)
    marks = np.array([w in RUN_MARKS for w in words], bool)
    keep = ~np.array([w in QUOTES for w in words], bool)
    brackets = set("".join(PAIRS))
    first = next((i for i, w in enumerate(words) if w not in RUN_MARKS and w not in QUOTES and w not in brackets), n)
    at = np.arange(n)
    after_mark = np.concatenate([[False], marks[:-1]]) if n else marks
    keep &= ~(marks & (after_mark | (at < first)))
    for opening, closing in PAIRS:
        change = np.array([(w == opening) - (w == closing) for w in words], np.int64)
        if not change.any():
            continue
        level = np.cumsum(change)
        lowest_before = np.minimum.accumulate(np.concatenate([[0], level]))[:-1]
        lowest_after = np.concatenate([np.minimum.accumulate(level[::-1])[::-1][1:], [n]])
        lowest_early = np.full(n, n)  # after a place, but before the first word
        if first > 1:
            lowest_early[: first - 1] = np.minimum.accumulate(level[:first][::-1])[::-1][1:]
        keep &= ~((change < 0) & ((level < lowest_before) | (at < first)))
        keep &= ~((change > 0) & ((lowest_after >= level) | (lowest_early < level)))
    return [word for word, stays in zip(words, keep) if stays]


def repair_udf():
    @kernel("array<string>")
    def repair(token_lists: pa.Array) -> pa.Array:
        return pa.array(
            [None if t is None else repaired_tokens(t) for t in token_lists.to_pylist()], pa.list_(pa.string())
        )

    return repair
