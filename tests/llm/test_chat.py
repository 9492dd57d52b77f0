"""Quotation linking: nested levels, bodies, reply trees, odd tables, and the query against SQL."""

import pytest
from compare import connect, difference

from redpen.llm import chat
from redpen.llm.queries import OP9_SQL, op9_quotation_linking

COLUMNS = "conv_id long, turn long, role string, text string, body string, thread long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], COLUMNS)


def by_turn(rows):
    return {(r["conv_id"], m["turn"]): (m["body"], m["reply_to"], m["depth"], r["thread"]) for r in rows for m in r["messages"]}


def test_nested_quotes(spark):
    rows = [
        (1, 0, "user", "How do  I start?\nPlease help."),
        (1, 1, "assistant", "On Monday user wrote:\n> how do i START?\nTurn the key."),
        (1, 2, "user", "> > How do I start?\n> Turn the key.\nWhich key?"),
        (1, 3, "user", "> Please help.\nMe too."),
        (1, 4, "assistant", "> something nobody said\nHello."),
        (2, 0, "user", "> Turn the key.\nOther conversation"),
    ]
    got = by_turn(chat.reply_ordered(table(spark, rows)).collect())
    assert got == {
        (1, 0): ("How do  I start?\nPlease help.", None, 0, 0),
        (1, 1): ("Turn the key.", 0, 1, 0),
        (1, 2): ("Which key?", 1, 2, 0),
        (1, 3): ("Me too.", 0, 1, 0),
        (1, 4): ("Hello.", 3, 2, 0),
        (2, 0): ("Other conversation", None, 0, 0),
    }
    links = {tuple(r) for r in chat.quote_links(chat.parse_messages(table(spark, rows))).select("turn", "level", "original").collect()}
    assert links == {(1, 1, 0), (2, 2, 0), (2, 1, 1), (3, 1, 0)}


def test_long_chain_in_bounded_rows(spark):
    rows = [(7, t, "user", f"message number {t}\nthe same line") for t in range(300)]
    got = chat.reply_ordered(chat.mail_view(table(spark, rows))).collect()
    assert max(len(r["messages"]) for r in got) <= chat.SEGMENT_TURNS
    found = by_turn(got)
    assert all(found[7, t][0] == f"message number {t}\nthe same line" for t in range(300))
    assert all(found[7, t][1] == (t - 2 if t % 4 == 3 else t - 1) for t in range(1, 300))


def test_odd_tables(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, 0, "user", "x"), (None, 1, "user", "a"), (1, None, "user", "b"), (1, 1, "user", ""), (1, 2, "a", ">" * 100_000)]
    got = chat.reply_ordered(table(spark, rows)).collect()
    assert sum(len(r["messages"]) for r in got) == 6
    found = by_turn(got)
    assert found[1, 1] == ("", 0, 1, 0) and found[1, 2] == ("", 1, 2, 0)
    assert found[None, 1] == ("a", None, 0, None)
    assert chat.reply_ordered(table(spark, [])).collect() == []


def test_chat_text(spark):
    rows = chat.reply_ordered(table(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "> a\nb")]))
    assert rows.select(chat.chat_text("messages")).first()[0] == "<|user|>\na\n<|assistant|>\nb"


def test_only_native_operators(spark):
    plan = op9_quotation_linking(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    assert difference(op9_quotation_linking(spark, sf), connect(sf), OP9_SQL) is None
