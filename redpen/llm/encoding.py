"""Token ids of whole texts by public tokenizers; a unit of text that was seen before is not encoded again.

A text is cut where its tokenizer never merges. Strings of special tokens are cut out first and stand for their ids, as the library
does it. New units of ASCII and the letters of Latin-1 are cut into the tokenizer's runs of letters, digits and signs here, and only
these runs go to the merges of the library, many in one text; all other units go through the whole library.
"""

from __future__ import annotations

import json
import re
from itertools import chain, compress, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOGETHER = 1000  # runs that go to the library in one text


def places_of(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all elements of slices of an array, one slice after the other; ends of the slices among them)."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 else np.int64
    places = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    places += np.arange(total, dtype=kind)
    return places, ends


class UnitEncoder:
    """Encodes texts unit by unit. A kind of tokenizer says how texts are cut, which units are plain and what their runs are.

    A unit is a text or, for a special token, a tuple with its id. The memory belongs to one task and is emptied when it is full.
    """

    RULES: list[dict] = []  # fixed values: the tokenizer's own rules for which ``runs`` stands
    SEPARATOR = " "  # between runs, not part of one
    MEMO_UNITS = 600_000  # encoded units that a task remembers

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.tokenizer.encode_special_tokens = True  # a unit in upper case may look like one once it is lowered
        self.special = special
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        state = self.tokenizer.pre_tokenizer.__getstate__() if self.tokenizer.pre_tokenizer else b"{}"
        cuts = json.loads(state)
        self.merges = None
        if isinstance(self.tokenizer.model, models.BPE) and cuts.get("pretokenizers", [cuts]) == self.RULES:
            self.merges = Tokenizer(self.tokenizer.model)  # the same vocabulary, held once
            self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(self.SEPARATOR)
            self.merges.model._resize_cache(0)  # each run comes once
            names, suffix = self.tokenizer.get_vocab(with_added_tokens=False), self.tokenizer.model.end_of_word_suffix or ""
            self.spelled = np.zeros(max(names.values()) + 1, np.int64)  # bytes that an id stands for
            self.spelled[list(names.values())] = [len(name.removesuffix(suffix)) for name in names]
            # signs of bytes: printable ones stand for themselves, the others follow from 256 on
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = [b for b in range(256) if b not in shown]
            self.signs = [(chr(b), chr(256 + hidden.index(b))) for b in hidden if b >= 0x80 or b == 0x20 != ord(self.SEPARATOR)]
        self.forget()

    def units(self, text: str) -> list:
        raise NotImplementedError

    def plain(self, units: list) -> list[bool]:
        """Which units consist of what ``runs`` knows."""
        raise NotImplementedError

    def runs(self, units: list) -> list[str]:
        """The runs of plain units, a line break between two units."""
        raise NotImplementedError

    def text(self, unit) -> str:
        """The text that a unit stands for."""
        raise NotImplementedError

    def forget(self) -> None:
        self.known: dict = {}
        self.pool, self.sizes, self.starts = np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int32)

    def pieces(self, text: str) -> list:
        """Parts of a text and, as tuples, the special tokens between them."""
        cut = self.cut_special(text) if self.cut_special else [text]
        cut[1::2] = [(self.special[name],) for name in cut[1::2]]
        return cut

    def _plain_ids(self, units: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per unit) of plain units; a run that several hold goes to the library once."""
        if not units:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        found = pa.array(self.runs(units), pa.string()).dictionary_encode()
        names, ids = found.dictionary.to_pylist(), []
        for at in range(0, len(names), TOGETHER):
            text = self.SEPARATOR.join(names[at : at + TOGETHER]).encode().decode("latin-1")
            for byte, sign in [("\n", ""), *self.signs]:
                text = text.replace(byte, sign)
            (got,) = self.merges.encode_batch_fast([text], add_special_tokens=False)
            ids.append(np.array(got.ids, np.uint32))
        ids = np.concatenate(ids)
        # the ids of a run spell its bytes
        line = names.index("\n") if "\n" in names else -1
        ends, spelled = np.cumsum(np.where(np.arange(len(names)) == line, 0, pc.binary_length(found.dictionary).to_numpy())), np.cumsum(self.spelled[ids])
        upto = np.searchsorted(spelled, ends, side="right")
        if not np.array_equal(np.append(0, spelled)[upto], ends):
            raise ValueError("the vocabulary does not spell all bytes")
        starts = np.append(0, upto[:-1])
        runs, sizes = found.indices.to_numpy(), upto - starts
        places, _ = places_of(starts[runs], sizes[runs])
        return ids[places], np.bincount(np.cumsum(runs == line), sizes[runs], len(units)).astype(np.int64)

    def _learn(self, new: list) -> None:
        special = [u for u in new if isinstance(u, tuple)]
        texts = [u for u in new if not isinstance(u, tuple)] if special else new
        fits = self.plain(texts) if self.merges else [False] * len(texts)
        plain, other = list(compress(texts, fits)), [u for u, fit in zip(texts, fits) if not fit]
        ids, sizes = self._plain_ids(plain)
        lists = [e.ids for e in self.tokenizer.encode_batch_fast([self.text(u) for u in other], add_special_tokens=False)] + [list(u) for u in special]
        self.pool = np.concatenate([self.pool, ids, np.fromiter(chain.from_iterable(lists), np.uint32)])
        self.sizes = np.concatenate([self.sizes, sizes, np.fromiter(map(len, lists), np.int64, len(lists))]).astype(np.int32)
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.known.update(zip(chain(plain, other, special), count(len(self.known))))

    def cut(self, texts) -> tuple[list, np.ndarray | None, np.ndarray]:
        """(units, the place of each unit of the texts among these or None if they are just these, units per text)."""
        units = [self.units(text) if text else [] for text in texts]
        return list(chain.from_iterable(units)), None, np.fromiter(map(len, units), np.int64, len(units))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after the other, ids per text)."""
        if len(self.known) > self.MEMO_UNITS:
            self.forget()
        flat, order, per_text = self.cut(texts)
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int32, len(flat))
        holes = np.flatnonzero(at < 0)
        if len(holes):
            missing = [flat[i] for i in holes.tolist()]
            self._learn(list(dict.fromkeys(missing)))
            at[holes] = np.fromiter(map(self.known.__getitem__, missing), np.int32, len(missing))
        if order is not None:
            at = at[order]
        starts, sizes = self.starts[at], self.sizes[at]
        places, ends = places_of(starts, sizes)
        edges = np.concatenate([[0], ends])[np.cumsum(np.append(0, per_text))]
        return self.pool[places], np.diff(edges)


class WordEncoder(UnitEncoder):
    """For a tokenizer that lowers case, drops white space and never merges over it: units are words between ASCII spaces, as bytes."""

    RULES = [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]
    PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
    CONTROLS = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]").search
    RUNS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+").findall

    def units(self, text: str) -> list:
        """bytes.lower and bytes.split know ASCII only."""
        cut = self.pieces(text)
        if len(cut) == 1:
            return text.encode().lower().split()
        return list(chain.from_iterable([part] if isinstance(part, tuple) else part.encode().lower().split() for part in cut))

    def plain(self, units: list) -> list[bool]:
        shown = not self.CONTROLS(b" ".join(units))
        return [shown and u.isascii() or self.PLAIN(u) is not None for u in units]

    def runs(self, units: list) -> list[str]:
        return self.RUNS(b"\n".join(units).decode().lower())

    def text(self, unit) -> str:
        return unit.decode()


class SpacedEncoder(UnitEncoder):
    """For a byte-level vocabulary, which never merges over the place before a space that a non-space follows: a unit begins with that space.

    Units are kept without it. MARK stands before one that has no space before it, as at the start of a text. A text whose white space
    stands alone is also cut around its line breaks, which are units of their own. Texts whose white space is single spaces and line breaks are
    cut by Arrow, where a unit that is repeated in a call becomes a Python string once.
    """

    RULES = [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}]
    SEPARATOR = "\t"
    MEMO_UNITS = 400_000  # their texts are Python strings, larger than bytes
    MARK = "\x01"  # no other unit starts with it
    PLAIN = "\\A\x01?[!-~À-ÖØ-öø-ÿ]+\\z"
    RUNS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^A-Za-z0-9À-ÖØ-öø-ÿ\n ]+").findall
    ODD_SPACE = re.compile(r" (?:\s|\Z)").search
    PAIRED_SPACE = re.compile(r"\s\s| \Z").search
    CUT = re.compile(r"(?<=.)(?= \S)", re.S).split
    # a mark, white space of Unicode other than spaces and line breaks, or any that does not stand alone
    ODD = r"[\x01\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]| \z"

    def _spaced(self, text: str) -> list[str]:
        if self.MARK in text:
            return [self.MARK + text]
        if self.ODD_SPACE(text):
            first, *rest = self.CUT(text)
            return [self.MARK + first, *[unit[1:] for unit in rest]]
        if not self.PAIRED_SPACE(text):
            text = text.replace("\n", " \n " + self.MARK)
        units = text.split(" ")
        units[0] = self.MARK + units[0]
        return units

    def units(self, text: str) -> list:
        return list(chain.from_iterable([part] if isinstance(part, tuple) else self._spaced(part) for part in self.pieces(text) if part))

    def cut(self, texts) -> tuple[list, np.ndarray | None, np.ndarray]:
        texts = pc.fill_null(pa.array(texts, pa.string()), "")
        odd = pc.match_substring_regex(texts, pattern=self.ODD)
        for name in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, pattern=name))
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        even = pc.if_else(odd, "", texts) if len(at) else texts
        even = pc.replace_substring(pc.binary_join_element_wise(self.MARK, even, ""), pattern="\n", replacement=" \n " + self.MARK)
        split = pc.split_pattern(even, pattern=" ")
        found, per_text = split.flatten().dictionary_encode(), pc.list_value_length(split).to_numpy().astype(np.int64)
        units, order = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        if len(at):  # their units take the places of the empty ones that stand for them
            others = [self.units(text) for text in texts.take(at).to_pylist()]
            owner = np.repeat(np.arange(len(per_text)), per_text)
            stay = ~np.isin(owner, at)
            per_text[at] = list(map(len, others))
            order = np.concatenate([order[stay], len(units) + np.arange(per_text[at].sum())])
            order = order[np.argsort(np.concatenate([owner[stay], np.repeat(at, per_text[at])]), kind="stable")]
            units += chain.from_iterable(others)
        return units, order, per_text

    def plain(self, units: list) -> list[bool]:
        return pc.match_substring_regex(pa.array(units, pa.string()), pattern=self.PLAIN).to_numpy(zero_copy_only=False).tolist()

    def runs(self, units: list) -> list[str]:
        return self.RUNS((" " + "\n ".join(units)).replace(" " + self.MARK, ""))

    def text(self, unit) -> str:
        if unit == "\n":
            return unit
        return unit[1:] if unit[:1] == self.MARK else " " + unit
