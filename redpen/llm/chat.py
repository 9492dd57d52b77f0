"""Quotation linking: replies find the messages they quote, and lose the quotes.

Everything is a DataFrame or SQL expression. A line that starts with ``>`` marks is quoted at
the level of their number; its words in lower case with single spaces are a passage. Passages are hashed and
joined to the first message of the conversation that says them itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from redpen.session import stage

SEGMENT_TURNS = 64  # turns of a conversation that are put in one row

MARKS = r"^(?=[ \t]{0,3}>)[ \t>]*"
# How mail programs announce a quotation.
ATTRIBUTION = r"(?i)^.{0,200}(wrote|schrieb|écrit|escribió)[^:]{0,80}:\s*$"


def parsed_lines(text: Column) -> Column:
    """Lines as structs ``level, body``; null and empty texts have no lines."""
    def line(raw: Column) -> Column:
        marks = F.regexp_extract(raw, MARKS, 0)
        return F.struct(
            F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
            F.substr(raw, F.length(marks) + 1).alias("body"),
        )

    return F.when(F.length(text) > 0, F.transform(F.split(text, "\n"), line)).otherwise(F.transform(F.array().cast("array<string>"), line))


def passage(body: Column) -> Column:
    """The hash of a normalised line, null where it has no words."""
    plain = F.trim(F.regexp_replace(F.lower(body), r"[\s\x{a0}]+", " "))
    return F.when(plain != "", F.md5(plain.cast("binary")))


def without_quotes(lines: Column) -> Column:
    """The text of the unquoted lines, without the lines that announce a quotation."""
    def own(x: Column, i: Column) -> Column:
        announces = x["body"].rlike(ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)
        return (x["level"] == 0) & ~announces

    return F.array_join(F.transform(F.filter(lines, own), lambda x: x["body"]), "\n")


def parse_messages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, lines, body``, each distinct row once; other columns are not read."""
    own = messages.select("conv_id", "turn", "role", "text").distinct()
    lines = own.select("conv_id", "turn", "role", parsed_lines(F.col("text")).alias("lines"))
    return lines.withColumn("body", without_quotes(F.col("lines")))


def quote_links(parsed: DataFrame) -> DataFrame:
    """``conv_id, turn, level, hash, original``: every quoted line whose passage an earlier turn says itself.

    ``original`` is the first such turn. One row per passage and conversation stands for all
    places that say it, so repeated passages do not multiply.
    """
    said = parsed.select("conv_id", "turn", F.explode(F.split("body", "\n")).alias("line"))
    said = said.select("conv_id", "turn", passage(F.col("line")).alias("hash")).filter("hash is not null")
    first = said.groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    quoted = parsed.select("conv_id", "turn", F.explode(F.filter("lines", lambda x: x["level"] > 0)).alias("line"))
    quoted = quoted.select("conv_id", "turn", "line.level", passage(F.col("line.body")).alias("hash")).filter("hash is not null")
    return quoted.join(first, ["conv_id", "hash"]).filter(F.col("original") < F.col("turn"))


def replies(parsed: DataFrame) -> DataFrame:
    """``conv_id, turn, parent, quoted``: one row per place of a conversation.

    The parent is the turn that most level-one lines quote, the later one of equals. A message
    without linked quotes answers the turn before it, if there is one.
    """
    votes = quote_links(parsed).filter("level = 1").groupBy("conv_id", "turn", "original").agg(F.count(F.lit(1)).alias("n"))
    chosen = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("n", "original")).alias("best"))
    places = parsed.select("conv_id", "turn").filter("conv_id is not null and turn is not null").distinct()
    before = places.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("follows"))
    return (
        places.join(chosen, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
        .select("conv_id", "turn", F.coalesce("best.original", F.when(F.col("follows"), F.col("turn") - 1)).alias("parent"),
                F.coalesce("best.n", F.lit(0)).cast("long").alias("quoted"))
    )


def threads(links: DataFrame) -> DataFrame:
    """Add ``thread`` (the turn at the root of the replies) and ``depth`` by doubling the pointers.

    Each pass halves the way to the root, so a chain of n replies takes log2(n) passes, and each
    pass joins on single turns: a large conversation is no large key.
    """
    start = {"up": F.col("parent"), "thread": F.coalesce("parent", "turn"), "depth": F.col("parent").isNotNull().cast("long")}
    now = stage(links.withColumns(start), "replies")
    settled = now.filter("up is null")
    pending = now.filter("up is not null")
    while pending.limit(1).count():
        # only messages below the roots found so far move on
        above = settled.unionByName(pending).select(
            "conv_id", F.col("turn").alias("up"), F.col("up").alias("_up"), F.col("thread").alias("_thread"), F.col("depth").alias("_depth")
        )
        now = stage(
            pending.join(above, ["conv_id", "up"]).select(
                "conv_id", "turn", "parent", "quoted", F.col("_up").alias("up"), F.col("_thread").alias("thread"),
                (F.col("depth") + F.col("_depth")).alias("depth"),
            ), "replies",
        )
        settled, pending = settled.unionByName(now.filter("up is null")), now.filter("up is not null")
    return settled.drop("up")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Conversations in reply order, without quotes: ``conv_id, thread, segment, messages``.

    ``messages`` holds structs ``turn, role, body, reply_to, depth, quoted``; a message comes after
    the one it answers. A row covers 64 turns of a thread, so a conversation of any length
    makes rows of bounded size. Exact repeated rows count once; different messages with the same
    turn share its links. Null texts are empty messages; messages without conv_id or turn
    are threads of their own with a null thread. Other columns are not read; an empty table gives no rows.
    """
    parsed = stage(parse_messages(messages), "messages")
    linked = threads(replies(parsed))
    placed = parsed.join(linked, ["conv_id", "turn"], "left")
    message = F.struct(
        "turn", "role", "body", F.col("parent").alias("reply_to"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("quoted", F.lit(0)).alias("quoted"),
    )
    keys = ["conv_id", "thread", F.floor(F.col("turn") / SEGMENT_TURNS).alias("segment")]
    loose = F.when(F.col("thread").isNull(), F.xxhash64("conv_id", "turn", "role", "body"))  # unplaced messages are not gathered
    return placed.groupBy(*keys, loose.alias("_loose")).agg(F.sort_array(F.collect_list(message)).alias("messages")).drop("_loose")


def chat_text(conversation: Column) -> Column:
    """The messages of a row as one text with role headers."""
    turns = F.transform(conversation, lambda m: F.concat(F.lit("<|"), F.coalesce(m["role"], F.lit("user")), F.lit("|>\n"), m["body"]))
    return F.array_join(turns, "\n")


def mail_view(messages: DataFrame) -> DataFrame:
    """Conversations as mail: every later turn quotes the turn it answers, and what that one answered one level deeper.

    Every fourth turn answers the turn two before it, so that replies branch.
    """
    own = messages.select("conv_id", "turn", "role", "text")
    answered = F.when(F.col("turn") % 4 == 3, F.col("turn") - 2).when(F.col("turn") > 0, F.col("turn") - 1)
    asked = own.withColumn("answers", answered)
    above = asked.select("conv_id", F.col("turn").alias("answers"), F.col("text").alias("text1"), F.col("answers").alias("answers2"))
    deeper = own.select("conv_id", F.col("turn").alias("answers2"), F.col("text").alias("text2"))
    joined = asked.join(above, ["conv_id", "answers"], "left").join(deeper, ["conv_id", "answers2"], "left")

    def quoted(text: str, marks: str) -> Column:
        return F.concat(F.lit(marks), F.regexp_replace(text, "\n", f"\n{marks}"), F.lit("\n"))

    head = F.concat(F.lit("On turn "), F.col("answers").cast("string"), F.lit(" they wrote:\n"))
    mail = F.concat(
        F.when(F.col("text1").isNotNull(), head).otherwise(""), F.coalesce(quoted("text2", ">> "), F.lit("")),
        F.coalesce(quoted("text1", "> "), F.lit("")), F.coalesce("text", F.lit("")),
    )
    return joined.select("conv_id", "turn", "role", mail.alias("text"))
