import json
import random

from tagweave.llm import chat
from tagweave.llm.chat import canonical, format_chats, violations

SCHEMAS = {"add": {"type": "object", "properties": {"a": {"type": "number"}, "b": {"type": "number"}}, "required": ["a", "b"], "additionalProperties": False}}


def call(i, name="add", **arguments):
    return f'<tool_call>{json.dumps({"id": i, "name": name, "arguments": arguments})}</tool_call>'


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


ROWS = [
    (1, 0, "user", "hi"),
    (1, 1, "assistant", "well " + call("x", b=2, a=1) + call("y", a=1)),
    (1, 2, "user", "and?"),
    (1, 3, "tool", result("y", "late")),
    (1, 4, "tool", result("x", {"z": 1, "a": [1, None]})),
    (1, 5, "tool", result("nobody", 1)),
    (1, 6, "tool", "no json"),
    (2, 0, "assistant", call("x", a="$ref:w", b=1)),
    (2, 1, "tool", result("x", 1)),
    (2, 2, "assistant", call("w", a=1, b=1) + call("q", name="other")),
    (2, 3, "tool", result("w", 5)),
    (3, 0, "assistant", call("m", a="$ref:n", b=1)),
    (3, 1, "assistant", call("n", a="$ref:m", b=1)),
    (None, None, None, None),
    (4, 0, "assistant", "<tool_call>{bad</tool_call>"),
    (4, 0, "assistant", "<tool_call>{bad</tool_call>"),
]


def answer(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, calls string").repartition(3)
    out = {}
    for r in format_chats(df, SCHEMAS).collect():
        out.setdefault(r.conv_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.position) for k, v in out.items()}


def test_linking_and_order(spark):
    got = answer(spark)
    assert [r.turn for r in got[1]] == [0, 1, 4, 3, 2, 5, 6]
    assert [r.position for r in got[1]] == list(range(7))
    assert [(r.result_of, r.linked) for r in got[1] if r.result_of] == [("x", True), ("y", True), ("nobody", False)]
    assert got[1][1].n_calls == 2 and got[1][1].n_answered == 2
    assert got[1][1].errors == ["add $.b: missing"]
    assert got[1][6].errors == ["result without identifier"]
    # the call that uses a result comes after the one that makes it
    order = [r.turn for r in got[2]]
    assert order.index(3) < order.index(1) and order.index(2) < order.index(0) < order.index(1)
    assert any("unknown tool" in e for r in got[2] for e in r.errors)
    assert all("calls wait for each other" in r.errors for r in got[3])
    assert len(got[4]) == 2 and got[4][0].errors == ["call 0: not readable"]
    assert json.loads(got[None][0].message) == {"role": "", "content": ""}


def test_messages_are_canonical(spark):
    for rows in answer(spark).values():
        for r in rows:
            assert canonical(json.loads(r.message)) == r.message
    m = json.loads(answer(spark)[1][1].message)
    assert m == {"role": "assistant", "content": "well ", "tool_calls": [{"id": "x", "name": "add", "arguments": {"a": 1, "b": 2}}, {"id": "y", "name": "add", "arguments": {"a": 1}}]}


def test_schemas():
    s = {"type": "array", "items": {"type": "object", "properties": {"k": {"enum": ["a", "b"]}, "n": {"type": "integer", "minimum": 0}}}}
    assert violations([{"k": "a", "n": 1}, {"k": "b"}], s) == []
    assert violations([{"k": "c"}, {"n": -1}, {"n": 1.5}, 3], s) == [
        "$[0].k: not one of the values", "$[1].n: out of bounds", "$[2].n: not of type integer", "$[3]: not of type object",
    ]
    assert violations(True, {"type": "number"}) and not violations(None, {"type": ["null", "string"]})
    assert violations("ab", {"pattern": "^b"}) == ["$: doesn't match the pattern"]


def test_plain_conversations(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    got = format_chats(turns).collect()
    assert len(got) == turns.count()
    want = {(r.conv_id, r.turn): canonical({"role": r.role, "content": r.text}) for r in turns.collect()}
    assert {(r.conv_id, r.turn): r.message for r in got} == want
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append((r.turn, r.position))
    assert all([p for _, p in sorted(v)] == list(range(len(v))) for v in by.values())


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_chats(df, SCHEMAS).collect() == []


def test_registered_query_checks_calls(spark, tmp_path):
    """Tools come from the system turns of a call's own conversation."""
    from tagweave.llm.queries import op9_chat_formatting

    add = {"type": "function", "function": {"name": "add", "parameters": SCHEMAS["add"]}}
    rows = [
        (1, 0, "system", f"Use <tools>{json.dumps(add)}\n{json.dumps({'name': 'free'})}</tools> well."),
        (1, 1, "assistant", call("a", a=1, b=2)),
        (1, 2, "assistant", call("b", a="1") + "<tool_call>no</tool_call>" + call("c", a=1, b=2, z=3)),
        (1, 3, "assistant", call("d", name="other") + call("e", name="free", q=1)),
        (2, 0, "assistant", call("a", a=1, b=2)),
        (3, 0, "system", "<tools>[{</tools>"),
        (3, 1, "system", f"<tools>{json.dumps([{'name': 'add', 'parameters': {'pattern': '('}}])}</tools>"),
        (3, 2, "assistant", '<tool_call>{"id": 1, "name": "add", "arguments": "x"}</tool_call>'),
        (None, 0, "system", f"<tools>{json.dumps([add])}</tools>"),
        (None, None, "assistant", call("a", a=1)),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn): r.errors for r in op9_chat_formatting(spark, str(tmp_path)).collect()}
    assert got == {
        (1, 0): "",
        (1, 1): "",
        (1, 2): "call 1: not readable; add $.b: missing; add $.a: not of type number; add $.z: unknown",
        (1, 3): "other: unknown tool",
        (2, 0): "add: unknown tool",
        (3, 0): "tools 0: not readable",
        (3, 1): "",
        (3, 2): "add: schema not usable",
        (None, 0): "",
        (None, -1): "add $.b: missing",
    }


def test_long_chains_and_cycles(spark):
    """Chains of any length are put in order; only calls that can't be placed are reported, by conversation."""
    n = 200
    rows = [(1, i, "assistant", call(f"c{i}", a=f"$ref:c{i + 1}" if i + 1 < n else 1)) for i in range(n)]
    rows += [(1, n + i, "tool", result(f"c{i}", i)) for i in range(n)]
    rows += [(2, 0, "assistant", "".join(call(f"c{i}", a=f"$ref:c{i - 1}" if i else 1) for i in range(n)))]
    rows += [(2, 1 + i, "tool", result(f"c{i}", i)) for i in range(n)] + [(2, n + 1, "user", "thanks")]
    rows += [(3, i, "assistant", call(f"c{i}", a=f"$ref:c{i + 1}" if i < 25 else 1)) for i in range(26)]
    # a cycle, a call behind it, one within a message, one before it
    rows += [(4, 0, "assistant", call("m", a="$ref:n")), (4, 1, "assistant", call("n", a="$ref:m", b="$ref:ok"))]
    rows += [(4, 2, "assistant", call("behind", a="$ref:n")), (4, 3, "assistant", call("p", a="$ref:q") + call("q", a="$ref:p"))]
    rows += [(4, 4, "assistant", call("ok")), (4, 5, "assistant", call("own", a="$ref:own")), (4, 6, "assistant", call("fine", a="$ref:ok"))]
    # a message moved behind the call that it uses takes the results of its other calls along
    rows += [(5, 0, "assistant", call("x") + call("y", a="$ref:z")), (5, 1, "tool", result("x", 1)), (5, 2, "tool", result("y", 1))]
    rows += [(5, 3, "assistant", call("z")), (5, 4, "tool", result("z", 1))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {}
    for r in sorted(format_chats(df, {"add": {}}).collect(), key=lambda r: (r.conv_id, r.position)):
        got.setdefault(r.conv_id, []).append(r)
    assert [r.turn for r in got[1]] == [t for i in reversed(range(n)) for t in (i, n + i)]
    assert [r.turn for r in got[2]] == list(range(n + 2))
    assert [r.turn for r in got[3]] == list(reversed(range(26)))
    assert not any(r.errors for c in (1, 2, 3, 5) for r in got[c])
    assert {r.turn for r in got[4] if r.errors == ["calls wait for each other"]} == {0, 1, 2, 3, 5}
    assert [r.turn for r in got[5]] == [3, 4, 0, 1, 2]


def plain_order(rows):
    """Positions of one conversation's turns, placing one message or call at a time until nothing moves."""
    parsed = []
    for i, (turn, role, text) in enumerate(rows):
        message, calls, result, *_ = chat.parse_turn(role, text, {})
        parsed.append({"turn": -1 if turn is None else turn, "row": i, "json": message, "calls": calls, "result": result})
    first = {}
    for p in sorted(parsed, key=lambda p: (p["turn"], p["row"])):
        for k, (ident, _) in enumerate(p["calls"]):
            first.setdefault(ident, (p["row"], k))
    needs = {(p["row"], k): [first[r] for r in refs if r in first] for p in parsed for k, (_, refs) in enumerate(p["calls"])}
    at = {p["row"]: p["turn"] for p in parsed}
    depth, messages, calls = dict.fromkeys(needs, 0), set(), set()
    linked = set(c for c in needs if needs[c]) | {n for v in needs.values() for n in v}
    moved = True
    while moved:
        moved = False
        for p in parsed:
            r = p["row"]
            outer = [n for k in range(len(p["calls"])) for n in needs[r, k] if n[0] != r]
            if r not in messages and all(n in calls for n in outer):
                messages.add(r)
                moved = True
            for n in outer:
                if n in calls:
                    at[r] = max(at[r], at[n[0]] + 1)
            for k in range(len(p["calls"])):
                inner = [n for n in needs[r, k] if n[0] == r]
                for n in inner:
                    if n in calls:
                        depth[r, k] = max(depth[r, k], depth[n] + 1)
                if (r, k) not in calls and r in messages and all(n in calls for n in inner):
                    calls.add((r, k))
                    moved = True
    import hashlib

    keys = []
    for p in parsed:
        own = first.get(p["result"]) if p["result"] is not None else None
        head = (at[own[0]], 1, depth[own], own[1]) if own else (at[p["row"]], 0, 0, 0)
        keys.append((*head, p["turn"], hashlib.md5(p["json"].encode()).hexdigest(), p["row"]))
    stuck = {r for r, k in linked if (r, k) not in calls}
    return [(rows[key[-1]][0], parsed[key[-1]]["json"], key[-1] in stuck) for key in sorted(keys)]


def random_conversation(r):
    rows, names = [], [f"n{i}" for i in range(r.randint(1, 9))]
    for t in range(r.randint(1, 8)):
        text = "".join(
            call(r.choice(names), a=r.choice([1, *(f"$ref:{x}" for x in names)]), b=[f"$ref:{r.choice(names)}"] if r.random() < 0.3 else 2) for _ in range(r.randint(0, 4))
        )
        rows.append((r.choice([t, t, t, 0, None]), "assistant", f"{t}" + text))
        if r.random() < 0.7:
            rows.append((r.randint(-2, 9), "tool", result(r.choice([*names, "lost"]), t)))
    return rows


def check_plain(spark, chats, **how):
    df = spark.createDataFrame([(c, *row) for c, rows in chats.items() for row in rows], "conv_id long, turn long, role string, text string").coalesce(1)
    got = {}
    for x in sorted(format_chats(df, {"add": {}}, **how).collect(), key=lambda x: (x.conv_id, x.position)):
        got.setdefault(x.conv_id, []).append((x.turn, x.message, "calls wait for each other" in x.errors))
    for c, rows in chats.items():
        assert [(-1 if t is None else t, m, s) for t, m, s in plain_order(rows)] == got[c], c


def test_against_plain_order(spark):
    r = random.Random(8)
    check_plain(spark, {c: random_conversation(r) for c in range(150)})


def test_large_connected_sets_go_by_rounds(spark, monkeypatch):
    """The same places when sets are dealt to several tasks, and when none fits into a task."""
    r = random.Random(9)
    chats = {c: random_conversation(r) for c in range(40)}
    monkeypatch.setattr(chat, "TASK_REFS", 20)
    monkeypatch.setattr(chat, "SET_REFS", 6)
    check_plain(spark, chats)


def test_hot_conversation_is_ranked_in_ranges(spark, monkeypatch):
    """Null and equal turns, equal texts and one conversation that holds most turns: every position once."""
    monkeypatch.setattr(chat, "CELL_TURNS", 50)
    rows = [(7, None, "user", f"t{i % 30}") for i in range(600)] + [(None, 3, "user", "same")] * 20 + [(8, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = format_chats(df).collect()
    for conv, n in ((7, 600), (None, 20), (8, 1)):
        assert sorted(r.position for r in got if r.conv_id == conv) == list(range(n))


def test_registered_query_adds_traffic(spark, sf):
    from tagweave.llm.queries import op9_chat_formatting, with_tool_traffic

    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    got = op9_chat_formatting(spark, sf).collect()
    assert len(got) == with_tool_traffic(turns).count() > turns.count()
    assert sum(r.n_calls for r in got) == 2 * turns.where("role = 'assistant'").count()
    text = " ".join(r.errors for r in got)
    assert all(e in text for e in ("unknown tool", "missing", "not of type integer", "out of bounds", "wait for each other"))
    assert any(r.linked for r in got) and any(r.linked is False for r in got)


HARD = [
    ("tool", '{"tool_call_id":"a","content":"\\ud83d"}'),
    ("tool", '{"tool_call_id":"\\udc00x","content":[1e999]}'),
    ("tool", '{"tool_call_id":"\\udc00x","content":NaN}'),
    ("tool", "[" * 200_000),
    ("tool", '{"tool_call_id":"deep","content":' + "[" * 150 + "]" * 150 + "}"),
    ("tool", '{"tool_call_id":"deep","content":' + "[" * 400 + "]" * 400 + "}"),
    ("tool", '{"tool_call_id":7,"content":' + "9" * 400 + "}"),
    ("tool", '{"tool_call_id":7,"content":' + "9" * 5000 + "}"),
    ("tool", "7"),
    ("assistant", "<tool_call>" + "[" * 100_000 + "</tool_call>"),
    ("assistant", '<tool_call>{"id":"\\ud800","name":"f\\udfff","arguments":{"k\\ud800":"$ref:\\ud800"}}</tool_call>'),
    ("assistant", '<tool_call>{"id":"n","name":"f","arguments":{"x":-Infinity}}</tool_call>'),
    ("assistant", '<tool_call>{"id":"big","name":"whole","arguments":{"x":' + "1" * 400 + "}}</tool_call>"),
    ("assistant", '<tool_call>{"id":"odd","name":"whole","arguments":{"x":1.5,"y\\ud800":1}}</tool_call>'),
    ("system", "<tools>" + '{"name":"whole","parameters":{"properties":{"x":{"type":"integer"}},"additionalProperties":false}}' + "</tools>"),
    ("system", "<tools>" + '[' * 100_000 + "</tools>"),
    ("system", '<tools>{"name":"t\\ud800","parameters":{"maximum":NaN}}</tools>'),
]


def test_no_text_fails_the_whole(spark):
    import json

    from tagweave.llm import chat

    rows = [(1, i, role, text) for i, (role, text) in enumerate(HARD)]
    got = {r.turn: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(HARD)

    def refuse(name):
        raise AssertionError(name)

    for i, r in got.items():
        json.loads(r.message, parse_constant=refuse)
        r.message.encode()
    assert json.loads(got[0].message)["content"] == "\ud83d" and "\\ud83d" in got[0].message
    unreadable = {i for i, r in got.items() if any("without identifier" in e for e in r.errors)}
    assert unreadable == {1, 2, 3, 5, 7, 8}
    assert {i for i, r in got.items() if any("not readable" in e for e in r.errors)} == {9, 11, 15, 16}
    assert got[12].errors == [] and got[10].n_calls == 1 and got[13].errors == ["whole $.x: not of type integer", "whole $.y\\ud800: unknown"]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """A chain of 3,000 calls, each using the next: pointers double, so rounds are as many as its length has digits."""
    from collections import Counter

    n = 3000
    edges = spark.createDataFrame([(i, i, 0, i + 1, i + 1, 0) for i in range(n)], "turn long, row_id long, k int, need_turn long, need_row long, need_k int")
    written, real = Counter(), chat.cut
    monkeypatch.setattr(chat, "cut", lambda df, name: (written.update([name]), real(df, name))[1])
    got = {r.row_id: r for r in chat._settle_rounds(edges).collect()}
    assert len(got) == n + 1 and not any(r.waits for r in got.values())
    assert all(got[i].at == n + (n - i) and got[i].depth == 0 for i in range(n + 1))
    assert written["chains"] <= 16 and written["placed"] <= 4, written
