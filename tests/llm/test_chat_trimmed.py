"""Trimmed and interleaved quotes find the message they come from."""

from weftline.llm import chat_quotes

MESSAGES = [
    (0, "first line\nsecond line\nthird line"),
    (1, "one paragraph\n\ntwo paragraph\n\nthree paragraph"),
    (2, "> other words\nrun a\nrun b\n> more words\nafter"),
    (3, "between"),
    (4, "> first line\n> second line\ntwo lines of three"),
    (5, "> one paragraph\n>\n> two paragraph\ntwo paragraphs of three"),
    (6, "> run a\n> run b\na run between quotes"),
    (7, "> first line\n> second line\n> third line\nthe whole"),
    (8, "> second line\n> never said\none line that is known"),
    (9, "> never said\n> nor this\nunknown"),
]


def test_parts_of_a_message_are_linked(spark):
    rows = [(1, turn, "user", text) for turn, text in MESSAGES]
    found = chat_quotes.query(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    turn_at = {r["position"]: r["turn"] for r in found}
    parents = {r["turn"]: turn_at.get(r["parent_position"]) for r in found}
    assert parents == {0: None, 1: 0, 2: 1, 3: 2, 4: 0, 5: 1, 6: 2, 7: 0, 8: 0, 9: 8}
    assert {r["turn"]: r["n_linked"] for r in found} == {t: int(4 <= t <= 8) for t in range(10)}
