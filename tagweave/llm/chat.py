"""Chat formatting with linked tool calls.

A turn's text may hold calls, ``<tool_call>{"id", "name", "arguments"}</tool_call>``,
and a turn of role ``tool`` holds one result, ``{"tool_call_id", "content"}``.
Calls and results are hash-joined by conversation and identifier. Messages are
put in topological order: results follow the message of their call, and a call
whose arguments name another call's result ("$ref:ID") follows that one. Only
calls that wait for each other, or for such calls, are left out and reported.
Arguments are checked against the JSON schemas that the conversation's system
turns declare, ``<tools>{"name", "parameters"} ...</tools>``, or the caller
gives, and each message becomes canonical JSON (sorted keys, no blanks).

JSON is read strictly: ``NaN`` and infinities, numbers beyond a double, whole
numbers of more digits than Python reads, and values nested deeper than
``MAX_DEPTH`` aren't readable, and the call, result or tool that holds them is
reported as such. Halves of surrogate pairs, which JSON may escape and UTF-8
can't hold, stay escaped.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import components, cut, drop, numbered_in, small_batches

_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
_TOOLS = re.compile(r"<tools>(.*?)</tools>", re.S)
_REF = re.compile(r"^\$ref:(.+)$", re.S)
#: Turns ranked in one task, references that one task puts in order, and of the largest connected set that still goes to a task.
CELL_TURNS, TASK_REFS, SET_REFS = 10_000, 50_000, 50_000


#: Levels of arrays and objects that a value may have.
MAX_DEPTH = 200
_HALF = re.compile("[\ud800-\udfff]")


def plain(text: str) -> str:
    """``text`` with halves of surrogate pairs as escapes, so that it can be written as UTF-8."""
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return plain(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _no_constant(name: str):
    raise ValueError(name)


def _double(digits: str) -> float:
    value = float(digits)
    if value in (float("inf"), float("-inf")):
        raise ValueError("beyond a double")
    return value


_JSON = json.JSONDecoder(parse_constant=_no_constant, parse_float=_double)


def _shallow(value):
    """``value``, if no part of it lies deeper than ``MAX_DEPTH``."""
    level = [value]
    for _ in range(MAX_DEPTH):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return value
    raise ValueError("nested too deep")


def read_json(text: str, at: int | None = None):
    """The value of a text, or (value, end) of the one that begins ``at``; ValueError for whatever can't be read."""
    try:
        if at is None:
            return _shallow(_JSON.decode(text))
        value, end = _JSON.raw_decode(text, at)
        return _shallow(value), end
    except RecursionError:
        raise ValueError("nested too deep") from None


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks a JSON schema: type, enum, required, properties, additionalProperties, items, bounds, pattern."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    wanted = schema.get("type")
    if wanted:
        ok = False
        for t in wanted if isinstance(wanted, list) else [wanted]:
            if t in ("number", "integer"):
                ok |= isinstance(value, (int, float)) and not isinstance(value, bool) and (t == "number" or isinstance(value, int) or value.is_integer())
            else:
                ok |= isinstance(value, kinds.get(t, object))
        if not ok:
            return [f"{at}: not of type {wanted}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"] or "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: out of bounds")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: doesn't match the pattern")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += violations(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    return out


def _refs(value) -> list[str]:
    todo, out = [value], []
    while todo:
        v = todo.pop()
        if isinstance(v, str) and (m := _REF.match(v)):
            out.append(plain(m[1]))
        elif isinstance(v, dict):
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return sorted(set(out))


def check_call(name: str, arguments, schema: dict) -> list[str]:
    try:
        return [plain(f"{name} {e}") for e in violations(arguments, schema)]
    except (re.error, TypeError, ValueError, AttributeError, OverflowError, RecursionError):
        return [plain(f"{name}: schema not usable")]


def declared_tools(text: str) -> tuple[list[tuple[str, str]], list[str]]:
    """[(name, JSON schema)] of the ``<tools>`` blocks of a system turn, and errors.

    A block holds a list of tools or one after another; each is {"name",
    "parameters"} or that within {"type": "function", "function"}. Without
    parameters any arguments do.
    """
    out, errors = [], []
    for k, m in enumerate(_TOOLS.finditer(text)):
        body, at = m[1].strip(), 0
        try:
            while at < len(body):
                value, at = read_json(body, at)
                for tool in value if isinstance(value, list) else [value]:
                    tool = tool.get("function", tool)
                    schema = tool.get("parameters") or {}
                    if not isinstance(schema, dict):
                        raise TypeError("no schema")
                    out.append((plain(str(tool["name"])), canonical(schema)))
                while at < len(body) and body[at] in " \t\r\n,":
                    at += 1
        except (ValueError, TypeError, KeyError, AttributeError, RecursionError):
            errors.append(f"tools {k}: not readable")
    return out, errors


def parse_turn(role: str | None, text: str | None, schemas: dict) -> tuple:
    """(canonical JSON, [(id, refs)], result id, errors, declared tools, calls to check) of one turn.

    Calls to check, (name, arguments as JSON), are those of tools that aren't in ``schemas``.
    """
    role, text = role or "", text or ""
    message, calls, result, errors, tools, unchecked = {"role": role}, [], None, [], [], []
    if role == "system":
        tools, errors = declared_tools(text)
    if role == "tool":
        try:
            body = read_json(text)
            result = plain(str(body["tool_call_id"]))
            message |= {"tool_call_id": str(body["tool_call_id"]), "content": body.get("content")}
        except (ValueError, TypeError, KeyError):
            message["content"] = text
            errors.append("result without identifier")
    else:
        listed = []
        for k, m in enumerate(_CALL.finditer(text)):
            try:
                body = read_json(m[1])
                name, arguments, ident = plain(str(body["name"])), body.get("arguments", {}), plain(str(body["id"]))
            except (ValueError, TypeError, KeyError):
                errors.append(f"call {k}: not readable")
                continue
            listed.append({"id": str(body["id"]), "name": str(body["name"]), "arguments": arguments})
            calls.append((ident, _refs(arguments)))
            if name in schemas:
                errors += check_call(name, arguments, schemas[name])
            else:
                unchecked.append((name, canonical(arguments)))
        message["content"] = _CALL.sub("", text) if listed else text
        if listed:
            message["tool_calls"] = listed
    return canonical(message), calls, result, errors, tools, unchecked


PARSED = (
    "conv_id long, turn long, row_id long, json string, calls array<struct<id: string, refs: array<string>>>, "
    "result_of string, errors array<string>, tools array<struct<name: string, schema: string>>, "
    "unchecked array<struct<name: string, arguments: string>>"
)


def _checked(parsed: DataFrame, key) -> DataFrame:
    """(row_id, found): what breaks the schemas that the conversation declares, of each turn with calls to check.

    A tool declared twice is the one declared first.
    """
    told = parsed.select(key, "turn", F.posexplode("tools").alias("k", "tool")).groupBy("conv", F.col("tool.name").alias("name"))
    told = told.agg(F.min(F.struct("turn", "k", "tool.schema")).alias("t")).select("conv", "name", "t.schema")
    asked = parsed.select(key, "row_id", F.posexplode("unchecked").alias("k", "call")).select("conv", "row_id", "k", "call.*")

    def run(batches):
        for batch in batches:
            found = [
                check_call(n, json.loads(a), json.loads(s)) if s is not None else [f"{n}: unknown tool"]
                for n, a, s in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["row_id", "k", "found"]
            )

    found = asked.join(told, ["conv", "name"], "left").select("row_id", "k", "name", "arguments", "schema")
    found = found.mapInArrow(run, "row_id long, k int, found array<string>").where("size(found) > 0")
    listed = found.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("k", "found"))).alias("f"))
    return listed.select("row_id", F.flatten("f.found").alias("found"))


#: A reference: the using call's turn, row and number in its row, then those of the call that it names.
EDGE = ("turn", "row_id", "k", "need_turn", "need_row", "need_k")
SETTLED = "row_id long, k int, at long, depth int, waits boolean"


def _settle(edges: pa.Table) -> pa.Table:
    """(row_id, k, at, depth, waits): places of calls that use results or whose results are used, of whole connected sets.

    A message can be placed when all calls of other messages that its own calls
    use are placed; a call when its message and the calls that it uses are.
    What can't be placed ``waits``. ``at`` is the message's turn, or more if
    it must follow messages that come later; ``depth`` counts calls before it
    in its own message.
    """
    turn, row, k, need_turn, need_row, need_k = (edges[c].to_numpy() for c in EDGE)
    rows, of = np.unique(np.concatenate([row, need_row]), return_inverse=True)
    at = np.zeros(len(rows), np.int64)
    at[of] = np.concatenate([turn, need_turn])
    keys, node = np.unique(np.stack([of, np.concatenate([k, need_k])]), axis=1, return_inverse=True)
    node = node.ravel()
    user, need = node[: len(row)], node[len(row):]
    n = len(rows)  # nodes: messages, then calls
    inner = keys[0][user] == keys[0][need]
    # a message waits for calls of others, a call for its message and for calls of the same message
    source = np.concatenate([n + need, keys[0]])
    target = np.concatenate([np.where(inner, n + user, keys[0][user]), n + np.arange(keys.shape[1])])
    by = np.argsort(source, kind="stable")
    target = target[by]
    total = n + keys.shape[1]
    start = np.searchsorted(source[by], np.arange(total + 1)).tolist()
    missing = np.bincount(target, minlength=total).tolist()
    target, home = target.tolist(), keys[0].tolist()
    later, depth = at.tolist(), [0] * keys.shape[1]
    ready = [i for i in range(total) if not missing[i]]
    while ready:
        i = ready.pop()
        for j in target[start[i] : start[i + 1]]:
            if i >= n and j < n:
                later[j] = max(later[j], later[home[i - n]] + 1)
            elif i >= n:
                depth[j - n] = max(depth[j - n], depth[i - n] + 1)
            missing[j] -= 1
            if not missing[j]:
                ready.append(j)
    return pa.table(
        {
            "row_id": pa.array(rows[keys[0]]),
            "k": pa.array(keys[1], pa.int32()),
            "at": pa.array(np.array(later)[keys[0]]),
            "depth": pa.array(depth, pa.int32()),
            "waits": pa.array([m > 0 for m in missing[n:]]),
        }
    )


#: What a node of one need gets from the node ``up`` that its chain leads to: at = max(base, at of up + add), and
#: depth = ``deep`` more than that of up, or ``deep`` where the chain ``resets`` it.
CHAIN = ("row_id", "k", "up_row", "up_k", "add", "base", "deep", "resets")


def _contracted(state: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(CHAIN of nodes whose chain ends, those that wait for a cycle) of the nodes with exactly one need, by pointer doubling.

    Each round joins every pointer with the pointer that it leads to, so a chain
    takes as many rounds as its length has binary digits. Pointers that still
    lead to such nodes then go round a cycle, or lead into one.
    """
    single = state.where("missing = 1").select("row_id", "k", "at").join(deps, ["row_id", "k"])
    same = F.col("row_id") == F.col("need_row")
    inner = same & (F.col("need_k") >= 0)
    chain = single.select(
        "row_id", "k", F.col("need_row").alias("up_row"), F.col("need_k").alias("up_k"), F.when(same, 0).otherwise(1).cast("long").alias("add"),
        F.col("at").alias("base"), F.when(inner, 1).otherwise(0).cast("long").alias("deep"), (~inner).alias("resets"),
    )
    chain = cut(chain, "chains")
    nodes = cut(chain.select("row_id", "k"), "singles")
    over = nodes.select(F.col("row_id").alias("up_row"), F.col("k").alias("up_k"))
    for _ in range(max(1, nodes.count()).bit_length() + 1):
        if not chain.join(over, ["up_row", "up_k"], "left_semi").take(1):
            break
        up = chain.toDF("up_row", "up_k", "up2_row", "up2_k", "add2", "base2", "deep2", "resets2")
        j = chain.join(up, ["up_row", "up_k"], "left")
        further = F.col("up2_row").isNotNull()
        new = j.select(
            "row_id", "k", F.coalesce("up2_row", "up_row").alias("up_row"), F.coalesce("up2_k", "up_k").alias("up_k"),
            (F.col("add") + F.coalesce("add2", F.lit(0))).alias("add"), F.greatest("base", F.col("base2") + F.col("add")).alias("base"),
            (F.col("deep") + F.when(further & ~F.col("resets"), F.col("deep2")).otherwise(0)).alias("deep"), (F.col("resets") | F.coalesce("resets2", F.lit(False))).alias("resets"),
        )
        new = cut(new, "chains")
        drop(chain)
        chain = new
    round_ = chain.join(over, ["up_row", "up_k"], "left_semi").select("row_id", "k")
    return cut(chain.join(over, ["up_row", "up_k"], "left_anti").select(*CHAIN), "chains"), round_


def _settle_rounds(edges: DataFrame) -> DataFrame:
    """What ``_settle`` gives, by rounds of joins: for connected sets too large for one task.

    Nodes with one need are first led to the node at the end of their chain.
    Each round then places all other nodes that wait for nothing any more, until
    none is left that can be placed; there is no bound on the rounds. A message
    is the node ``k`` = -1 of its row.
    """
    none = F.lit(-1)
    inner = F.col("row_id") == F.col("need_row")
    calls = edges.select("turn", "row_id", "k").union(edges.select("need_turn", "need_row", "need_k")).distinct()
    used = edges.select("row_id", F.when(inner, F.col("k")).otherwise(none).alias("k"), "need_row", "need_k")
    deps = cut(used.union(calls.select("row_id", "k", "row_id", none)), "needs")  # a reference named twice counts twice
    missing = deps.groupBy("row_id", "k").agg(F.count(F.lit(1)).alias("missing"))
    nodes = calls.union(calls.select("turn", "row_id", none)).distinct().join(missing, ["row_id", "k"], "left")
    # ``at`` of a call is its message's, once that is placed; ``depth`` counts calls before it in its message
    every = nodes.select("row_id", "k", F.coalesce("missing", F.lit(0)).alias("missing"), F.col("turn").cast("long").alias("at"), F.lit(0).cast("long").alias("depth"))
    every = cut(every, "state")
    chain, stuck = _contracted(every, deps)
    state = cut(every.where("missing <> 1"), "state")
    # what each need of the nodes left gives: through the end of its chain, or itself
    asks = deps.join(state.select("row_id", "k"), ["row_id", "k"], "left_semi")
    via = asks.join(chain.toDF("need_row", "need_k", "up_row", "up_k", "c_add", "c_base", "c_deep", "c_resets"), ["need_row", "need_k"], "left")
    same = F.col("row_id") == F.col("need_row")
    step = F.when(same, 0).otherwise(1)
    deeper = same & (F.col("need_k") >= 0)
    via = via.select(
        "row_id", "k", F.coalesce("up_row", "need_row").alias("up_row"), F.coalesce("up_k", "need_k").alias("up_k"), (F.coalesce("c_add", F.lit(0)) + step).alias("add"),
        (F.col("c_base") + step).alias("base"), F.when(deeper, F.coalesce("c_deep", F.lit(0)) + 1).otherwise(0).alias("deep"), (~deeper | F.coalesce("c_resets", F.lit(False))).alias("resets"),
    )
    via, done = cut(via, "needs"), []
    while True:
        ready = state.where("missing = 0")
        if not ready.take(1):
            break
        done.append(cut(ready, "placed"))
        told = via.join(done[-1].select(F.col("row_id").alias("up_row"), F.col("k").alias("up_k"), "at", "depth"), ["up_row", "up_k"])
        news = told.groupBy("row_id", "k").agg(
            F.count(F.lit(1)).alias("fewer"),
            F.max(F.greatest(F.col("at") + F.col("add"), "base")).alias("new_at"),
            F.max(F.col("deep") + F.when(F.col("resets"), 0).otherwise(F.col("depth"))).alias("new_depth"),
        )
        left = state.where("missing > 0").join(news, ["row_id", "k"], "left").select(
            "row_id",
            "k",
            (F.col("missing") - F.coalesce("fewer", F.lit(0))).alias("missing"),
            F.greatest("at", "new_at").alias("at"),
            F.greatest("depth", "new_depth").alias("depth"),
        )
        left = cut(left, "state")
        drop(state)
        state = left
    columns = ["row_id", "k", "at", "depth"]
    out = state.select(*columns, F.lit(True).alias("waits"))
    if done:  # one scan over the tables of all rounds
        placed = edges.sparkSession.read.schema(state.schema).parquet(*(d._tagweave_path for d in done))
        out = out.union(placed.select(*columns, F.lit(False).alias("waits")))
    out = cut(out, "placed")
    ends = out.select(F.col("row_id").alias("up_row"), F.col("k").alias("up_k"), F.col("at").alias("up_at"), F.col("depth").alias("up_depth"), "waits")
    led = chain.join(ends, ["up_row", "up_k"]).select(
        "row_id",
        "k",
        F.when(F.col("waits"), None).otherwise(F.greatest("base", F.col("up_at") + F.col("add"))).alias("at"),
        (F.col("deep") + F.when(F.col("resets"), 0).otherwise(F.col("up_depth"))).alias("depth"),
        "waits",
    )
    led = led.union(stuck.select("row_id", "k", F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(True)))
    # nodes that wait stay at their own turn
    led = led.join(every.select("row_id", "k", F.col("at").alias("turn")), ["row_id", "k"]).select("row_id", "k", F.coalesce("at", "turn").alias("at"), F.when(F.col("waits"), 0).otherwise(F.col("depth")).cast("long").alias("depth"), "waits")
    out = out.union(led)
    # a call is shown at its message's place, even if the message has one and the call has none
    message = out.where("k = -1").select("row_id", F.col("at").alias("own"))
    return out.where("k >= 0").join(message, "row_id").select("row_id", "k", F.col("own").alias("at"), F.col("depth").cast("int").alias("depth"), "waits")


def settled_calls(edges: DataFrame, task_refs: int, set_refs: int) -> DataFrame:
    """SETTLED of all calls in ``edges``: connected sets are dealt to tasks, larger ones than ``set_refs`` go by rounds of joins."""
    total = edges.count()
    if total <= min(task_refs, set_refs):
        return edges.select(*EDGE, F.lit(0).alias("bucket")).groupBy("bucket").applyInArrow(_settle, SETTLED)
    roots = components(edges.select(F.col("row_id").alias("a"), F.col("need_row").alias("b")))
    rooted = edges.join(roots.withColumnRenamed("node", "row_id"), "row_id", "left").withColumn("root", F.coalesce("root", "row_id"))
    sizes = rooted.groupBy("root").agg((F.count(F.lit(1)) > set_refs).alias("large"))
    rooted = cut(rooted.join(sizes, "root").withColumn("bucket", F.pmod(F.xxhash64("root"), F.lit(-(-total // task_refs)))), "refs")
    out = rooted.where("not large").select(*EDGE, "bucket").groupBy("bucket").applyInArrow(_settle, SETTLED)
    if rooted.where("large").take(1):
        out = out.union(_settle_rounds(rooted.where("large").select(*EDGE)))
    return out


def format_chats(turns: DataFrame, schemas: dict | None = None) -> DataFrame:
    """(conv_id, position, turn, message, n_calls, n_answered, result_of, linked, errors), one row per turn.

    ``position`` counts from 0 without gaps in each conversation. A result
    without a call keeps its turn's place with ``linked`` false. If an
    identifier is used twice, results belong to its first call. Null
    identifiers of conversations form one conversation, null turns come first;
    null roles and texts are empty. Every call is checked: against ``schemas``
    (by tool) or, if its tool isn't there, against what the system turns of its
    conversation declare; a tool in neither is reported as unknown. Turns that
    tie are ordered by a digest of their message; repeated rows stay repeated,
    further columns are left aside, and an empty table gives an empty one.
    """
    schemas = schemas or {}
    small_batches(turns.sparkSession)

    def run(batches):
        call = pa.list_(pa.struct([("id", pa.string()), ("refs", pa.list_(pa.string()))]))
        tool = pa.list_(pa.struct([("name", pa.string()), ("schema", pa.string())]))
        asked = pa.list_(pa.struct([("name", pa.string()), ("arguments", pa.string())]))
        for batch in batches:
            got = [parse_turn(r, t, schemas) for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    pa.array([g[0] for g in got], pa.string()),
                    pa.array([[{"id": i, "refs": r} for i, r in g[1]] for g in got], call),
                    pa.array([g[2] for g in got], pa.string()),
                    pa.array([g[3] for g in got], pa.list_(pa.string())),
                    pa.array([[{"name": n, "schema": s} for n, s in g[4]] for g in got], tool),
                    pa.array([[{"name": n, "arguments": a} for n, a in g[5]] for g in got], asked),
                ],
                ["conv_id", "turn", "row_id", "json", "calls", "result_of", "errors", "tools", "unchecked"],
            )

    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    parsed = cut(rows.mapInArrow(run, PARSED), "turns")
    key = F.coalesce("conv_id", F.lit(-(1 << 62))).alias("conv")
    if parsed.where("size(unchecked) > 0").take(1):
        parsed = parsed.join(_checked(parsed, key), "row_id", "left").withColumn(
            "errors", F.concat("errors", F.coalesce("found", F.array().cast("array<string>")))
        )
        parsed = cut(parsed.drop("tools", "unchecked", "found"), "turns")
    else:
        parsed = parsed.drop("tools", "unchecked")
    calls = parsed.select(key, "turn", "row_id", F.posexplode("calls").alias("k", "call")).select(
        "conv", "turn", "row_id", "k", "call.id", "call.refs"
    )
    first = calls.groupBy("conv", "id").agg(F.min(F.struct("turn", "row_id", "k", "refs")).alias("c"))
    first = cut(first.select("conv", "id", "c.turn", "c.row_id", "c.k"), "calls").withColumn("at", F.col("turn"))
    # references within each conversation; those to nothing order nothing
    refs = calls.select("conv", "turn", "row_id", "k", F.explode("refs").alias("id"))
    if not refs.take(1):
        first = first.withColumn("depth", F.lit(0))
        places = parsed.select("row_id", F.lit(None).cast("long").alias("new_at"), F.lit(False).alias("cycle")).limit(0)
    else:
        needed = first.select("conv", "id", F.col("turn").alias("need_turn"), F.col("row_id").alias("need_row"), F.col("k").alias("need_k"))
        edges = refs.join(needed, ["conv", "id"])
        settled = cut(settled_calls(cut(edges.select(*EDGE), "refs"), TASK_REFS, SET_REFS), "settled")
        places = settled.groupBy("row_id").agg(F.max("at").alias("new_at"), F.max("waits").alias("cycle"))
        first = first.join(places.select("row_id", "new_at"), "row_id", "left").join(settled.select("row_id", "k", "depth"), ["row_id", "k"], "left")
        first = first.withColumn("at", F.coalesce("new_at", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0))).drop("new_at")
    answers = parsed.where("result_of is not null").select(key, F.col("result_of").alias("id"), F.col("row_id").alias("result_row"))
    linked = answers.join(first, ["conv", "id"])
    place = linked.select(F.col("result_row").alias("row_id"), F.col("at"), F.lit(1).alias("after"), "depth", "k")
    answered = linked.select("row_id", "id").distinct().groupBy("row_id").agg(F.count(F.lit(1)).alias("n_answered"))
    out = (
        parsed.select("*", key)
        .join(place, "row_id", "left")
        .join(places.withColumnRenamed("new_at", "call_at"), "row_id", "left")
        .join(answered, "row_id", "left")
    )
    out = cut(out, "linked")
    zero = F.lit(0)
    keys = out.select(
        "conv",
        F.coalesce("at", "call_at", "turn").alias("anchor"),
        *(F.coalesce(c, zero).alias(c) for c in ("after", "depth", "k")),
        "turn",
        F.md5("json").alias("print"),
        "row_id",
    )
    ranks = numbered_in(keys, "conv", CELL_TURNS).select("row_id", "rank")
    errors = F.when(F.col("cycle"), F.array_append("errors", F.lit("calls wait for each other"))).otherwise(F.col("errors"))
    return out.join(ranks, "row_id").select(
        "conv_id",
        F.col("rank").alias("position"),
        "turn",
        F.col("json").alias("message"),
        F.size("calls").cast("long").alias("n_calls"),
        F.coalesce("n_answered", F.lit(0)).cast("long").alias("n_answered"),
        "result_of",
        F.when(F.col("result_of").isNotNull(), F.col("at").isNotNull()).alias("linked"),
        errors.alias("errors"),
    )
