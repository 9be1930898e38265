import re

from weftline.llm import chat_quotes

SCHEMA = "conv_id long, turn long, role string, text string, position string"


def plain(messages):
    """(conv, turn) -> (position, parent position, content, quotes, linked) by walking each tree."""
    norm = lambda t: re.sub(r"\s+", " ", t).strip(" ").lower()
    out = {}
    for conv in {m[0] for m in messages}:
        thread = sorted((m for m in messages if m[0] == conv), key=lambda m: m[1])
        seen, children, infos = {}, {}, []
        for at, (_, turn, _, text) in enumerate(thread):
            runs = []
            for line in re.split(r"\r?\n", text or ""):
                prefix = re.match(r"^(?:[ \t]*>)+[ \t]?", line)
                level = prefix.group().count(">") if prefix else 0
                body = line[prefix.end() :] if prefix else line
                if runs and runs[-1][0] == level:
                    runs[-1][1].append(body)
                else:
                    runs.append((level, [body]))
            own = re.sub(r"^\s+|\s+$", "", "\n".join("\n".join(b) for lv, b in runs if lv == 0))
            quotes = [(lv, norm("\n".join(b))) for lv, b in runs if lv]
            hits = [(-lv, seen[q]) for lv, q in quotes if q and q in seen]
            parent = max(hits)[1] if hits else at - 1
            infos.append((own, len(quotes), len(hits), parent))
            if at:
                children.setdefault(parent, []).append(at)
            for unit in [own, *re.split(r"\n\s*\n", own), *own.split("\n")]:
                if norm(unit):
                    seen.setdefault(norm(unit), at)
        order, stack = [], [0]
        while stack:
            at = stack.pop()
            order.append(at)
            stack += reversed(children.get(at, []))
        place = {at: k for k, at in enumerate(order)}
        for at, (own, n, hits, parent) in enumerate(infos):
            out[conv, thread[at][1]] = (place[at], place[parent] if at else None, own, n, hits)
    return out


MESSAGES = [
    (1, 0, "user", "Hello  World\n\nsecond paragraph"),
    (1, 1, "assistant", "> hello world\nFirst answer"),
    (1, 2, "user", "> Second   paragraph\nOn the second"),
    (1, 3, "user", "> First answer\n>> hello world\nReply to the answer"),
    (1, 4, "assistant", "no quote at all"),
    (1, 5, "user", "> > hello world\n> nothing like it\nnested only"),
    (1, 6, "user", "> Reply to the answer\r\nbranch of a branch"),
    (1, 7, "user", "> On the second\n"),
    (1, 8, "user", "> later words\nasks early"),
    (1, 9, "user", "later words"),
    (2, 0, "user", "> hello world\nother conversation"),
    (2, 3, "assistant", None),
    (2, 4, None, ""),
    (2, 7, "user", ">\n>>  \n> other conversation\nx"),
    (3, 5, "user", "a > b\n >c"),
]


def test_quotes_are_linked_and_ordered(spark):
    df = spark.createDataFrame([(*m, "clash") for m in MESSAGES], SCHEMA)
    wanted = plain(MESSAGES)
    rows = chat_quotes.query(df).collect()
    assert len(rows) == len(MESSAGES)
    for r in rows:
        found = (r["position"], r["parent_position"], r["content"], r["n_quotes"], r["n_linked"])
        assert found == wanted[r["conv_id"], r["turn"]], r
        assert r["formatted"] == f"<|{r['role'] or 'user'}|>\n{r['content']}\n<|end|>\n"


def test_deep_branches(spark):
    """Every message quotes the one two before it: paths nest and doubling takes several rounds."""
    messages = [(1, i, "user", f"> m{i - 2}\nm{i}" if i > 1 else f"m{i}") for i in range(40)]
    wanted = plain(messages)
    for r in chat_quotes.query(spark.createDataFrame([(*m, "") for m in messages], SCHEMA)).collect():
        assert (r["position"], r["parent_position"]) == wanted[1, r["turn"]][:2]


def test_odd_rows(spark):
    rows = [(None, None, None, None, "")] * 3 + [(None, 1, "user", "> a\n" * 5000, ""), (4, 0, "u", "x " * 50_000, "")]
    found = chat_quotes.query(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["position"] for r in found if r["conv_id"] is None) == [0, 1, 2, 3]
    assert chat_quotes.query(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chats_join_in_reply_order(spark):
    df = spark.createDataFrame([(*m, "") for m in MESSAGES[:3]], SCHEMA)
    linked = chat_quotes.query(df)
    chat = chat_quotes.formatted_conversations(linked).first()
    blocks = [r["formatted"] for r in sorted(linked.collect(), key=lambda r: r["position"])]
    assert (chat["messages"], chat["chat"]) == (3, "".join(blocks))
