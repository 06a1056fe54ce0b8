"""Short passages don't link conversations in the query, and ids need not be numbers."""

from ravelin.llm import quote_linking

SCHEMA = "conv_id {}, turn long, role string, text string"


def test_short_passages_stay_in_their_conversation(spark):
    long = "this is a sentence that nobody else would ever say"
    rows = [(1, 0, "u", "Thanks"), (1, 1, "u", long), (2, 0, "u", "> Thanks\nok fine"), (3, 0, "u", f"> {long}\nso true"), (3, 1, "u", "Thanks"), (3, 2, "u", "> Thanks\nwelcome")]
    got = {(r["conv_id"], r["turn"]): r for r in quote_linking.reply_order(spark.createDataFrame(rows, SCHEMA.format("long")), far_words=quote_linking.FAR_WORDS).collect()}
    assert got[2, 0]["parent_conv"] is None and got[2, 0]["n_linked"] == 0
    assert (got[3, 0]["parent_conv"], got[3, 0]["parent_turn"]) == (1, 1)
    assert (got[3, 2]["parent_conv"], got[3, 2]["parent_turn"]) == (3, 1)


def test_text_ids(spark):
    rows = [("a-1", 0, "u", "first words here"), ("a-1", 1, "u", "> first words here\nyes"), ("b", 0, "u", "> first words here\nhm"), (None, 0, "u", "no id")]
    got = quote_linking.reply_order(spark.createDataFrame(rows, SCHEMA.format("string"))).collect()
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert len(got) == 4 and by["a-1", 1]["parent_turn"] == 0 and by["b", 0]["parent_conv"] == "a-1" and by["b", 0]["thread_conv"] == "a-1"
