"""Piece encoding: the most probable segmentation over a double-array trie, and its reverse.

A text becomes a space marker and its characters with spaces as markers. No piece holds a
marker behind another character, so the best segmentation of a text is the best one of each
word with the marker before it; a batch segments each distinct word once, all words of
similar length at the same time.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from redpen.functions.kernels import kernel
from redpen.llm.batches import lists, parts

MARKER = "▁"
UNKNOWN_PENALTY = 10.0  # below the least probable piece
CELLS = 1 << 17  # characters segmented together


@dataclass
class DoubleArray:
    """A trie over character codes: the child of s by c is base[s] + c if check[...] is s."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # piece id of a state or -1

    @classmethod
    def build(cls, words: dict[tuple[int, ...], int]) -> DoubleArray:
        size = 1 << 16
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        lowest = 1  # no free cell lies before it
        ordered = sorted(words)
        pending = [(0, 0, len(ordered), 0)]  # state, range of words below it, depth
        while pending:
            state, low, high, depth = pending.pop()
            if len(ordered[low]) == depth:
                value[state] = words[ordered[low]]
                low += 1
            starts = [i for i in range(low, high) if i == low or ordered[i][depth] != ordered[i - 1][depth]]
            if not starts:
                continue
            codes = np.array([ordered[i][depth] for i in starts])
            while check[lowest] >= 0:
                lowest += 1
            at = lowest
            while True:
                if at + codes[-1] >= size - 1:
                    grow = np.full(size, -1, np.int32)
                    base, check, value = np.concatenate([base, grow * 0]), np.concatenate([check, grow]), np.concatenate([value, grow])
                    size *= 2
                if check[at] < 0 and at >= codes[0] and (check[at - codes[0] + codes] < 0).all():
                    break
                at += 1
            first = at - codes[0]
            base[state] = first
            check[first + codes] = state
            for i, after, code in zip(starts, [*starts[1:], high], codes):
                pending.append((int(first + code), i, after, depth + 1))
        return cls(base, check, value)


@dataclass
class Vocabulary:
    """Pieces with log scores; everything here is bounded by the vocabulary."""

    pieces: list[bytes]  # what each id stands for
    scores: np.ndarray
    codes: np.ndarray  # by code point; 0 is in no piece
    trie: DoubleArray
    longest: int
    byte_ids: np.ndarray | None
    unknown_id: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a piece model.

        Scores of a unigram model are log probabilities and taken as they are. A merge model
        only ranks its pieces; they get the log of Zipf probabilities, 1 / (rank + 2.7).
        """
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        model = SentencePieceProcessor(model_proto=proto.SerializeToString())
        ids = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in ids]
        ordinary = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in ids]
        scores = np.array([model.get_score(i) for i in ids])
        if proto.trainer_spec.model_type == 2:
            scores = np.array([-math.log(max(-s, 0.0) + 2.7) for s in scores])
            scores -= math.log(sum(math.exp(s) for s, o in zip(scores, ordinary) if o))
        used = sorted({c for n, o in zip(names, ordinary) if o for c in n})
        codes = np.zeros(0x110000, np.int32)
        codes[[ord(c) for c in used]] = np.arange(1, len(used) + 1)
        trie = DoubleArray.build({tuple(codes[[ord(c) for c in n]].tolist()): i for i, n, o in zip(ids, names, ordinary) if o})
        if any(MARKER in n.lstrip(MARKER) for n, o in zip(names, ordinary) if o):
            raise ValueError("a piece holds a space marker behind another character")
        byte_ids = np.zeros(256, np.int32)
        pieces = []
        for i, name in zip(ids, names):
            if model.is_byte(i):
                byte_ids[int(name[3:5], 16)] = i
                pieces.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i):
                pieces.append(b"")
            else:
                pieces.append(" ⁇ ".encode() if model.is_unknown(i) else name.replace(MARKER, " ").encode())
        has_bytes = any(model.is_byte(i) for i in ids)
        longest = max(len(n) for n, o in zip(names, ordinary) if o)
        scores = np.where(ordinary, scores, scores[ordinary].min() - UNKNOWN_PENALTY)
        return cls(pieces, scores, codes, trie, longest, byte_ids if has_bytes else None, model.unk_id())


def units_of(text: str) -> list[str]:
    """The words of a text, each standing for a marker and its characters; further spaces stay in front."""
    if not text:
        return []
    text = text.replace(MARKER, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [unit[1:] for unit in re.findall(" +[^ ]*", " " + text)]
    return text.split(" ")


class Segmenter:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.unknown = float(vocabulary.scores.min())

    def _edges(self, codes: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the piece that ends at each place, by its length.

        ``codes`` is a matrix of words; in the result (places, words, longest) the last axis runs
        from the longest piece to the shortest, so that the first of equals is the longest.
        """
        trie, longest = self.v.trie, self.v.longest
        rows, places = codes.shape
        scores = np.full((places, rows, longest), -np.inf, np.float32)
        ids = np.full((places, rows, longest), -1, np.int32)
        row, start = np.nonzero(np.arange(places)[None, :] < lengths[:, None])
        scores[start, row, longest - 1] = self.unknown
        state = np.zeros(len(row), np.int32)
        for size in range(1, min(longest, width) + 1):
            end = start + size - 1
            inside = end < lengths[row]
            row, start, end, state = row[inside], start[inside], end[inside], state[inside]
            code = codes[row, end]
            after = trie.base[state] + code
            ok = (code > 0) & (trie.check[np.minimum(after, len(trie.check) - 1)] == state) & (after < len(trie.check)) & (after > 0)
            row, start, end, state = row[ok], start[ok], end[ok], after[ok]
            if not len(row):
                break
            piece = trie.value[state]
            hit = piece >= 0
            scores[end[hit], row[hit], longest - size] = self.v.scores[piece[hit]]
            ids[end[hit], row[hit], longest - size] = piece[hit]
        return scores, ids

    def _segment(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words one after the other, ids per word, best score per word); ``points`` is a matrix."""
        rows, places = points.shape
        longest = self.v.longest
        scores, ids = self._edges(self.v.codes[points], lengths, places)
        best = np.full((rows, places + longest), -np.inf)
        best[:, longest - 1] = 0.0  # column j + longest is the best score up to and with place j
        back = np.zeros((places, rows), np.int8 if longest < 128 else np.int32)
        for j in range(places):
            reached = best[:, j : j + longest] + scores[j]
            back[j] = choice = reached.argmax(1)
            best[:, j + longest] = reached[np.arange(rows), choice]
        # walk back from the end of each word
        row, at = np.arange(rows), lengths - 1
        steps = []
        while len(row):
            choice = back[at, row].astype(np.int64)
            steps.append((row, ids[at, row, choice], points[row, at]))
            at = at - (longest - choice)
            row, at = row[at >= 0], at[at >= 0]
        owner, piece, point = (np.concatenate(x) for x in zip(*reversed(steps)))
        order = np.argsort(owner, kind="stable")  # the walk ran backwards, so the earlier piece comes first
        owner, piece, point = owner[order], piece[order], point[order]
        if self.v.byte_ids is not None and (unknown := piece < 0).any():
            raw = [self.v.byte_ids[list(chr(p).encode("utf-8", "surrogatepass"))] for p in point[unknown].tolist()]
            sizes = np.ones(len(piece), np.int64)
            sizes[unknown] = [len(x) for x in raw]
            flat = np.repeat(piece, sizes)
            flat[np.repeat(unknown, sizes)] = np.concatenate(raw)
            owner, piece = np.repeat(owner, sizes), flat
        piece = np.where(piece < 0, self.v.unknown_id, piece)
        return piece.astype(np.int32), np.bincount(owner, minlength=rows), best[np.arange(rows), lengths - 1 + longest]

    def words(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids per unit, score per unit); units of similar length are segmented together."""
        spelled = [MARKER + u.replace(" ", MARKER) for u in units]
        lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        order = np.argsort(lengths, kind="stable")
        ends = np.cumsum(lengths) - lengths
        flat = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), np.uint32)
        results, low = [], 0
        while low < len(order):
            # as many words as fit when padded to the longest of them
            widths = lengths[order[low:]]
            fits = np.searchsorted(widths * np.arange(1, len(widths) + 1), CELLS, side="right")
            short = np.searchsorted(widths, widths[0] + 2 + widths[0] // 4, side="right")
            now = order[low : low + max(1, min(fits, short))]
            width = int(lengths[now[-1]])
            places = np.minimum(ends[now][:, None] + np.arange(width)[None, :], len(flat) - 1)
            results.append((now, *self._segment(flat[places], lengths[now])))
            low += len(now)
        sizes, scores = np.zeros(len(units), np.int64), np.zeros(len(units))
        for now, _, n, s in results:
            sizes[now], scores[now] = n, s
        starts = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), np.int32)
        for now, got, n, _ in results:
            ids[np.repeat(starts[now] - (np.cumsum(n) - n), n) + np.arange(len(got))] = got
        return ids, sizes, scores

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids per text, score per text)."""
        units = [units_of(t) for t in texts]
        flat = list(chain.from_iterable(units))
        distinct = dict(zip(dict.fromkeys(flat), count()))
        ids, sizes, scores = self.words(list(distinct)) if distinct else (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0))
        at = np.fromiter(map(distinct.__getitem__, flat), np.int64, len(flat))
        starts, size = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = ids[np.repeat(starts - (ends - size), size) + np.arange(total)]
        bounds = np.cumsum([len(u) for u in units], dtype=np.int64)
        upto, sums = np.concatenate([[0], ends])[bounds], np.concatenate([[0.0], np.cumsum(scores[at])])[bounds]
        return out, np.diff(upto, prepend=0), np.diff(sums, prepend=0.0)


def decode(pieces: list[bytes], ids: np.ndarray) -> str:
    """The text of a list of ids: markers become spaces, byte pieces bytes; the first space goes."""
    data = b"".join(map(pieces.__getitem__, ids.tolist()))
    return data.removeprefix(b" ").decode("utf-8", "replace")


def with_pieces(df: DataFrame, text: str, vocabulary: Vocabulary, ids: str = "ids", score: str = "score") -> DataFrame:
    """All columns, the ids of each text and its log probability. Row-local: no shuffle.

    Null and empty texts have no ids and score 0. Texts go through in small parts, so a task holds little at a time.
    """
    def run(batches):
        segmenter = Segmenter(vocabulary)
        for batch in batches:
            for part in parts(batch, text):
                found, sizes, scores = segmenter.texts([t or "" for t in part[text].to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, lists(found, sizes, pa.int32()), pa.array(scores, pa.float64())], [*part.schema.names, ids, score]
                )

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{fields}, `{ids}` array<int>, `{score}` double")


def decode_column(ids: Column, vocabulary: Vocabulary) -> Column:
    """The text of each list of ids; null stays null."""
    pieces = vocabulary.pieces

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if not x.is_valid else decode(pieces, x.values.to_numpy()) for x in column], pa.string())

    return kernel("string")(run)(ids)


def encode_pieces(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``key, ids, score`` of whole texts, one row per input row. Row-local: no shuffle.

    Null and empty texts give an empty list. Decoding gives the text back, but for the marker
    character itself, which comes back as a space. Other columns are not read.
    """
    own = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return with_pieces(own, "_text", Vocabulary.load(path)).select(F.col("_key").alias(key), "ids", "score")
