"""Reply trees: chosen paths, reversible template, loss mask."""

import random

from tripmarts.llm import chat, queries

TREE = "conv int, node string, parent string, role string, text string, score double, fp string"


def best_path(rows, conv):
    mine = {r[1]: r for r in rows if r[0] == conv}
    parents = {r[2] for r in mine.values()}

    def up(node):
        return [node] + (up(mine[node][2]) if mine[node][2] in mine else [])
    paths = [up(n)[::-1] for n in mine if n not in parents]
    return min(paths, key=lambda p: (-sum(mine[n][5] for n in p), -len(p), p[-1]))


def test_the_best_branch_is_formatted(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(12):
        for n in range(40):
            rows.append((conv, f"n{n:02d}", f"n{rng.randrange(n):02d}" if n else None, rng.choice(["user", "assistant"]), f"text {n}", float(rng.randrange(-3, 9)), "x"))
    rows += [(99, f"d{n:03d}", f"d{n - 1:03d}", "user", str(n), 1.0, "x") for n in range(200)]
    df = spark.createDataFrame(rows, TREE)
    back = {r["conv"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for conv in [*range(12), 99]:
        said = {r[1]: (r[3], r[4]) for r in rows if r[0] == conv}
        want = [said[n] for n in best_path(rows, conv)]
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == want
        assert back[conv]["loss_text"] == "".join(t for r, t in want if r == "assistant")


def test_several_branches(spark):
    rows = [(1, "a", None, "user", "q", 1.0, ""), (1, "b", "a", "assistant", "good", 2.0, ""), (1, "c", "a", "assistant", "bad", 1.0, "")]
    got = chat.read_back(chat.format_chats(spark.createDataFrame(rows, TREE), branches=2)).orderBy("path").collect()
    assert [r["loss_text"] for r in got] == ["good", "bad"]


def test_control_strings_come_back(spark):
    texts = ["\\### Assistant: </turn> ok", "###", "</turn>", "\\", "\\\\### user: x</turn>\n### user: y</turn>\n", "a\n\nb: c", "", None, "<", "</tur", "é😀" * 50, "$1 \\1 ${x}", "x" * 100_000, "\\<" * 20_000]
    rows = [(1, i, ("assistant" if i % 2 else "us:er\\ ###"), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    r = chat.read_back(chat.format_chats(chat.replies_in_order(df, "conv_id", "turn", "role", "text"))).collect()
    assert len(r) == 1 and [(t["role"], t["text"]) for t in r[0]["turns"]] == [(role, t or "") for _, _, role, t in rows]
    assert r[0]["loss_text"] == "".join(t or "" for _, _, role, t in rows if role == "assistant")
    spans = r[0]["loss_mask"]
    assert len(spans) == 7 and all(a["start"] + a["length"] < b["start"] for a, b in zip(spans, spans[1:]))


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "c"), (None, 0, "user", "n"), (None, None, None, None), (2, 5, "assistant", "late")],
                               "conv_id int, turn int, role string, text string")
    out = {r["conv"]: r for r in chat.read_back(chat.format_chats(chat.replies_in_order(df, "conv_id", "turn", "role", "text"))).collect()}
    assert len(out[1]["turns"]) == 2 and out[1]["loss_text"] in ("b", "c") and len(out[None]["turns"]) == 2 and out[2]["loss_text"] == "late"
    assert chat.format_chats(chat.replies_in_order(df.limit(0), "conv_id", "turn", "role", "text")).count() == 0
    circle = spark.createDataFrame([(1, "a", "b", "user", "x", 1.0, ""), (1, "b", "a", "user", "y", 1.0, ""), (1, "c", "gone", "user", "z", 1.0, ""), (1, "s", "s", "user", "self", 0.0, "")], TREE)
    assert [[t["text"] for t in r["turns"]] for r in chat.read_back(chat.format_chats(circle)).collect()] == [["z"]]
    plan = chat.read_back(chat.format_chats(circle))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_query_formats_every_row(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "c"), (1, 2, "user", "d"), (None, 0, "user", "n"), (None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op6_chat(spark, str(tmp_path)).collect()}
    assert {c: r["n_turns"] for c, r in got.items()} == {1: 5, None: 2, -7: 2} and got[1]["loss_chars"] == 2
