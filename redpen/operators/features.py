"""Fixed-length feature rows from tokens, tags and a word-piece vocabulary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from redpen.functions import text
from redpen.functions.kernels import (
    cut_udf, edit_rows_udf, flat_pieces_udf, id_rows_udf, pair_rows_udf, piece_text_udf, pieces_udf, sentence_pieces_udf, spread_ids_udf,
    starts_udf, substrings_udf, toggled_udf, token_cutter,
)
from redpen.operators.lookup import Lookup, key_filter, with_found
from redpen.operators.tagging import source_tokens
from redpen.session import stage

CLS, SEP, PAD = "[CLS]", "[SEP]", "[PAD]"


class PieceVocabulary:
    """A word-piece table of any size: cuts tokens and looks up ids.

    A table that is small enough travels to the tasks once. For a larger one the distinct tokens of the rows are cut with those of
    their substrings that a join finds in the table, and the pieces come back to the rows.

    Where the table travels and ids are not masked (``held``), feature rows are made by one kernel that cuts no further than they reach.
    """

    def __init__(self, vocab: DataFrame, lower: bool = True, masking: bool = False):
        self.lookup = Lookup(vocab, "token", "token_id")
        self.lower, self.masking = lower, masking
        rows = self.lookup.rows
        pad = rows.get(PAD) if rows is not None else next((r[0] for r in vocab.filter(F.col("token") == PAD).select("token_id").collect()), None)
        self._pad_id = pad
        self.held = None if masking or self.lookup.kind not in ("int", "bigint") else self.lookup.held
        if rows is not None:
            self._cut_udf = pieces_udf(self.lookup.held, lower)
            self._sentence_udf = sentence_pieces_udf(self.lookup.held, lower)
        else:
            self.longest = vocab.agg(F.coalesce(F.max(F.length("token")), F.lit(0))).first()[0]
            self.bitmap = vocab.sparkSession.sparkContext.broadcast(key_filter(vocab, "token"))

    def _cut_table(self, tokens: DataFrame) -> DataFrame:
        """``token, pieces`` of distinct tokens."""
        asked = tokens.withColumn("_asked", substrings_udf(self.bitmap, self.longest, self.lower)("token"))
        found = with_found(asked, "_asked", self.lookup.table, "token", "token_id")
        return found.select("token", cut_udf(self.lower)("token", "found_keys").alias("pieces"))

    def cutter(self):
        """What cuts tokens in a kernel, None where the table does not travel."""
        return None if self.lookup.rows is None else token_cutter(self.lookup.held, self.lower)

    def add_pieces(self, df: DataFrame, **tokens: Column) -> DataFrame:
        """Add columns with one list of pieces per token of a token list."""
        for out, column in tokens.items():
            if self.lookup.rows is not None:
                df = df.withColumn(out, self._cut_udf(column))
                continue
            df = stage(df.withColumn("_tokens", column), "tokens")
            cut = stage(self._cut_table(df.select(F.explode("_tokens").alias("token")).distinct()), "cut-tokens")
            df = Lookup.joined(cut, "token", "pieces").add(df, out, F.col("_tokens")).drop("_tokens")
        return df

    def add_flat_pieces(self, df: DataFrame, **texts: Column) -> DataFrame:
        """Add columns with all pieces of a text in one list."""
        if self.lookup.rows is not None:
            return df.withColumns({out: flat_pieces_udf(self.lookup.held, self.lower)(column) for out, column in texts.items()})
        df = self.add_pieces(df, **{out: text.tokens(column) for out, column in texts.items()})
        return df.withColumns({out: F.flatten(out) for out in texts})

    def add_piece_text(self, df: DataFrame, **texts: Column) -> DataFrame:
        """Add columns with all pieces of a text, joined by spaces."""
        if self.lookup.rows is not None:
            return df.withColumns({out: piece_text_udf(self.lookup.held, self.lower)(column) for out, column in texts.items()})
        return self.add_flat_pieces(df, **texts).withColumns({out: text.spaced(F.col(out)) for out in texts})

    def add_sentence_pieces(self, df: DataFrame, out: str, sentences: Column) -> DataFrame:
        """Add one flat list of pieces per sentence of a list of token lists."""
        if self.lookup.rows is not None:
            return df.withColumn(out, self._sentence_udf(sentences))
        df = df.withColumn("_sentences", sentences)
        df = self.add_pieces(df, _all=F.flatten("_sentences"))
        upto = F.aggregate("_sentences", F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.size(s))))
        df = df.withColumn("_upto", upto)
        flat = F.transform("_sentences", lambda s, i: F.flatten(F.slice("_all", F.get("_upto", i) + 1, F.size(s))))
        return df.withColumn(out, flat).drop("_sentences", "_all", "_upto")

    def add_ids(self, df: DataFrame, **pieces: Column) -> DataFrame:
        """Add columns with the ids of flat piece lists, after masking if that is switched on."""
        for out, column in pieces.items():
            df = self.lookup.add(df, out, F.transform(column, text.masked_piece) if self.masking else column)
        return df

    @property
    def pad_id(self) -> int:
        if self._pad_id is None:
            raise KeyError(PAD)
        return self._pad_id


def wordpiece_table(df: DataFrame, vocab: PieceVocabulary, col: str = "tokens") -> DataFrame:
    """Add ``pieces``: one list per token."""
    return vocab.add_pieces(df, pieces=F.col(col))


def padded(items: Column, length: int, fill: Column) -> Column:
    return F.concat(items, F.array_repeat(fill, F.greatest(F.lit(length) - F.size(items), F.lit(0))))


def piece_starts(pieces: Column) -> Column:
    """Position of the first piece of every token, counting the leading ``[CLS]``."""
    return starts_udf()(pieces)


# Pieces after which the sentence segment toggles.
TOGGLE_PIECES = [".", ",", ";", "!", "?", ":", "##.", "##,", "##;", "##!", "##?", "##:"]


def sentence_segments(pieces: Column) -> Column:
    """0/1 per piece: parity of the toggling pieces before it."""
    return toggled_udf(TOGGLE_PIECES)(pieces)


# Part-of-speech tags in id order, ids counted from 3.
POS_TAGS = {
    "full": [
        "CC", "CD", "DT", "EX", "FW", "IN", "JJ", "JJR", "JJS", "LS", "MD", "NN", "NNS", "NNP", "NNPS", "PDT", "POS", "PRP",
        "PRP$", "RB", "RBR", "RBS", "RP", "TO", "UH", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "WDT", "WP", "WP$", "WRB", ".", "X",
    ],
    "concise": ["VERB", "NOUN", "PRON", "ADJ", "ADV", "ADP", "CONJ", "DET", "NUM", "PRT", "X", "."],
}
POS_FIRST_ID = 3
POS_START = 2


def pos_ids(tags: Column, tagset: str) -> Column:
    """Part-of-speech ids; a tag outside the set takes the next free id."""
    known = POS_TAGS[tagset]
    listed = F.array(*map(F.lit, known))
    return F.transform(
        tags,
        lambda t: (
            F.when(F.array_contains(listed, t), F.array_position(listed, t) + (POS_FIRST_ID - 1))
            .otherwise(POS_FIRST_ID + len(known))
            .cast("int")
        ),
    )


def pos_segments(pieces: Column, ids: Column) -> Column:
    """The id of a token, repeated over its pieces."""
    return repeat_over_pieces(ids, pieces)


def _pos_table(tagset: str) -> tuple[dict[str, int], int]:
    """The ids of a tag set, and the one of all other tags."""
    known = POS_TAGS[tagset]
    return {t: i for i, t in enumerate(known, POS_FIRST_ID)}, POS_FIRST_ID + len(known)


def token_pos_segments(df: DataFrame, vocab: PieceVocabulary, tagset: str, tokens: str = "tokens", tags: str = "tags", out: str = "ids") -> DataFrame:
    """Add the part-of-speech id of each token, repeated over its pieces."""
    if vocab.lookup.rows is not None:
        return df.withColumn(out, spread_ids_udf(vocab.lookup.held, vocab.lower, *_pos_table(tagset))(tokens, tags))
    rows = vocab.add_pieces(df, _p=F.col(tokens))
    return rows.withColumn(out, pos_segments(F.col("_p"), pos_ids(F.col(tags), tagset))).drop("_p")


def repeat_over_pieces(values: Column, pieces: Column) -> Column:
    return F.flatten(F.zip_with(values, pieces, lambda v, p: F.array_repeat(v, F.size(p))))


EMBEDDINGS = ("normal", "sentence", "pos", "pos_concise")


def _edit_rows(
    df: DataFrame, vocab: PieceVocabulary, labels: Lookup, max_len: int, embedding: str, keep: tuple[str, ...], made: tuple[str, ...]
) -> DataFrame:
    """The feature rows with tables that travel."""
    own = vocab.held, vocab.lower
    marks = TOGGLE_PIECES if embedding == "sentence" else []
    labelled, starts = "labels" in made, next((c for c in ("token_starts", "row_starts") if c in made), None)
    udf = edit_rows_udf(*own, max_len, vocab.pad_id, vocab.lookup.kind, marks, labels.held if labelled else None, labels.kind, starts)
    rows = udf("tokens", "tags") if labelled else udf("tokens")
    step, segments = df.withColumn("_r", rows), F.col("_r.segment_ids")
    if embedding in ("pos", "pos_concise"):
        tagset = "full" if embedding == "pos" else "concise"
        last = POS_FIRST_ID + len(POS_TAGS[tagset]) + 1
        step = step.withColumn("_pos", spread_ids_udf(*own, *_pos_table(tagset), max_len, POS_START, last)("tokens", "pos_tags"))
        segments = F.col("_pos")
    also = ["labels", "labels_mask"] * labelled + ["token_starts"] * (starts is not None)
    return step.select(*keep, "_r.input_ids", "_r.input_mask", segments.alias("segment_ids"), *[f"_r.{c}" for c in also])


def edit_features(
    df: DataFrame,
    vocab: PieceVocabulary,
    label_map: DataFrame | dict,
    max_len: int,
    embedding: str = "normal",
    keep: tuple[str, ...] = ("pair_id",),
    made: tuple[str, ...] = ("labels", "token_starts"),
) -> DataFrame:
    """``input_ids, input_mask, segment_ids, labels, labels_mask`` of length ``max_len``, labels and starts if they are in ``made``.

    Needs ``tokens`` and ``tags``, and ``pos_tags`` for the part-of-speech embeddings.
    ``token_starts`` is the position of each token's first piece before truncation; with ``row_starts`` in ``made`` it is any
    position behind the row for tokens that begin there.
    """
    if isinstance(label_map, dict):
        label_map = df.sparkSession.createDataFrame(list(label_map.items()), "tag string, tag_id int")
    if embedding not in EMBEDDINGS:
        raise ValueError("embedding must be normal, sentence, pos or pos_concise")
    labels = Lookup(label_map, "tag", "tag_id")
    if vocab.held is not None and labels.held is not None and labels.kind in ("int", "bigint"):
        return _edit_rows(df, vocab, labels, max_len, embedding, keep, made)
    room = max_len - 2
    step = vocab.add_pieces(labels.add(df, "_l", F.col("tags")), _p=F.col("tokens"))
    step = step.withColumns({
        "_flat": F.slice(F.flatten("_p"), 1, room),
        "_lab": F.slice(repeat_over_pieces(F.col("_l"), F.col("_p")), 1, room),
        "token_starts": piece_starts(F.col("_p")),
    })
    zeros = F.transform("_flat", lambda p: F.lit(0))
    first, last = 0, 0
    if embedding == "normal":
        segments = zeros
    elif embedding == "sentence":
        segments = sentence_segments(F.col("_flat"))
    else:
        tagset = "full" if embedding == "pos" else "concise"
        segments = F.slice(pos_segments(F.col("_p"), pos_ids(F.col("pos_tags"), tagset)), 1, room)
        first, last = POS_START, POS_FIRST_ID + len(POS_TAGS[tagset]) + 1

    def framed(items: Column, start, end) -> Column:
        return F.concat(F.array(F.lit(start)), items, F.array(F.lit(end)))

    zero = F.lit(0)
    step = vocab.add_ids(step, _ids=framed(F.col("_flat"), CLS, SEP))
    return step.select(
        *keep,
        padded(F.col("_ids"), max_len, F.lit(vocab.pad_id)).alias("input_ids"),
        padded(F.transform("_ids", lambda i: F.lit(1)), max_len, zero).alias("input_mask"),
        padded(framed(segments, first, last), max_len, zero).alias("segment_ids"),
        padded(framed(F.col("_lab"), 0, 0), max_len, zero).alias("labels"),
        padded(framed(F.transform("_lab", lambda i: F.lit(1)), 0, 0), max_len, zero).alias("labels_mask"),
        "token_starts",
    )


def token_labels(labels: Column, unmasked: Callable[[Column], Column], starts: Column, keep_id: int) -> Column:
    """Label of each token at its first piece; cut or masked tokens are kept.

    ``unmasked`` tells for a position whether its label counts.
    """
    return F.transform(
        starts, lambda at: F.coalesce(F.when(unmasked(at), F.get(labels, at)), F.lit(keep_id))
    )


def _text_features(df: DataFrame, vocab: PieceVocabulary, col: str, max_len: int, suffix: str) -> DataFrame:
    names = {c: f"{c}{suffix}" for c in ("input_ids", "input_mask", "segment_ids")}
    if vocab.held is not None:
        made = id_rows_udf(vocab.held, vocab.lower, max_len, vocab.pad_id, vocab.lookup.kind)
        rows = df.withColumn(f"_r{suffix}", made(col))
        return rows.withColumns({out: F.col(f"_r{suffix}.{c}") for c, out in names.items()}).drop(f"_r{suffix}")
    step = vocab.add_pieces(df, _p=text.tokens(F.col(col)))
    pieces = F.slice(F.flatten("_p"), 1, max_len - 2)
    step = vocab.add_ids(step, _ids=F.concat(F.array(F.lit(CLS)), pieces, F.array(F.lit(SEP))))
    return step.withColumns({
        f"input_ids{suffix}": padded(F.col("_ids"), max_len, F.lit(vocab.pad_id)),
        f"input_mask{suffix}": padded(F.transform("_ids", lambda i: F.lit(1)), max_len, F.lit(0)),
        f"segment_ids{suffix}": F.array_repeat(F.lit(0), max_len),
    }).drop("_p", "_ids")


def grammar_features(df: DataFrame, vocab: PieceVocabulary, max_len: int, col: str = "text") -> DataFrame:
    """Features of one text next to its label."""
    return _text_features(df, vocab, col, max_len, "")


def meaning_features(
    df: DataFrame, vocab: PieceVocabulary, max_len: int, source: str = "source", summary: str = "summary"
) -> DataFrame:
    """Features of a source and its summary next to their label."""
    return _text_features(_text_features(df, vocab, source, max_len, "_source"), vocab, summary, max_len, "_summary")


def fitted_lengths(a: Column, b: Column, room: Column | int) -> tuple[Column, Column]:
    """Lengths after shortening the longer side (the second on ties) until both fit."""
    room = F.lit(room) if isinstance(room, int) else room
    keep_a = F.least(a, F.greatest(F.ceil(room / 2).cast("int"), room - b))
    keep_b = F.least(b, F.greatest(F.floor(room / 2).cast("int"), room - a))
    return keep_a, keep_b


def pair_features(
    df: DataFrame,
    vocab: PieceVocabulary,
    max_len: int,
    labels: list[str] | None = None,
    text_a: str = "text_a",
    text_b: str = "text_b",
    label: str = "label",
) -> DataFrame:
    """``[CLS] a [SEP] b [SEP]`` rows; a null second text gives a single-text row."""
    label_ids = {}
    if labels is not None:
        label_ids["label_id"] = (F.nullif(F.array_position(F.array(*map(F.lit, labels)), F.col(label)), F.lit(0)) - 1).cast("int")
    if vocab.held is not None:
        rows = df.withColumn("_r", pair_rows_udf(vocab.held, vocab.lower, max_len, vocab.lookup.kind)(text_a, text_b))
        made = {c: F.col(f"_r.{c}") for c in ("input_ids", "input_mask", "segment_ids")}
        return rows.withColumns(made | label_ids).drop("_r")
    step = vocab.add_pieces(df, _a=text.tokens(F.col(text_a)), _b=text.tokens(F.coalesce(F.col(text_b), F.lit(""))))
    step = step.withColumns({c: F.flatten(c) for c in ("_a", "_b")})
    two = F.col(text_b).isNotNull() & (F.size("_b") > 0)
    keep_a, keep_b = fitted_lengths(F.size("_a"), F.size("_b"), max_len - 3)
    step = step.withColumns({
        "_a": F.slice("_a", F.lit(1), F.when(two, keep_a).otherwise(F.lit(max_len - 2))),
        "_b": F.slice("_b", F.lit(1), F.when(two, keep_b).otherwise(F.lit(0))),
        "_two": two,
    })
    head = F.concat(F.array(F.lit(CLS)), F.col("_a"), F.array(F.lit(SEP)))
    tail = F.when(F.col("_two"), F.concat("_b", F.array(F.lit(SEP)))).otherwise(F.expr("cast(array() as array<string>)"))
    step = vocab.add_ids(step, _ids=F.concat(head, tail)).withColumn("_h", F.size("_a") + 2)
    segment = F.transform("_ids", lambda x, i: F.when(i < F.col("_h"), 0).otherwise(1))
    out = {
        "input_ids": padded(F.col("_ids"), max_len, F.lit(0)),
        "input_mask": padded(F.transform("_ids", lambda i: F.lit(1)), max_len, F.lit(0)),
        "segment_ids": padded(segment, max_len, F.lit(0)),
    }
    return step.withColumns(out | label_ids).drop("_a", "_b", "_two", "_ids", "_h")


def vocab_with_mask_tokens(vocab: DataFrame) -> DataFrame:
    """Put ``[SYMBOL]`` and ``[NUMBER]`` into the first unused slots when they are missing."""
    needed = ["[SYMBOL]", "[NUMBER]"]
    unused = F.col("token").rlike(r"^(\[UNUSED_.*\]|\[unused.*\])$")
    present = {r.token for r in vocab.filter(F.col("token").isin(needed)).select("token").distinct().collect()}
    slots = [r.token_id for r in vocab.filter(unused).orderBy("token_id").limit(len(needed)).collect()]
    missing = [t for t in needed if t not in present]
    if len(missing) > len(slots):
        raise IndexError("there is no unused slot in the vocabulary")
    token = F.col("token")
    for name, slot in zip(missing, slots):
        token = F.when(F.col("token_id") == slot, F.lit(name)).otherwise(token)
    return vocab.withColumn("token", token)


def feature_tokens(df: DataFrame) -> DataFrame:
    """Add ``tokens`` of ``sources``, for rows that are to be predicted."""
    return df.withColumn("tokens", source_tokens(F.col("sources")))
