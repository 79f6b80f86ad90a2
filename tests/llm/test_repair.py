import hashlib
import random
import re
import zlib

import pytest

from tagweave.llm import repair as R

LEGAL = re.compile(r"(s?(ua)+)?")


def all_repairs(rows):
    """(cost, audit, repaired rows) of every way to edit ``rows``, with two rows inserted in a place at most, kept below a bound."""
    bound = 2 * len(rows)

    def go(i, cost, audit, out, added):
        if cost > bound:
            return
        if i == len(rows) and LEGAL.fullmatch("".join(r[:1] or "-" for r, _ in out)):
            yield cost, audit, out
        if added < 2:
            for role in ("user", "assistant"):
                yield from go(i, cost + 5, audit + "I", [*out, (role, "")], added + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            yield from go(i + 1, cost + 2, audit + "D", out, 0)
            if fault not in (1, 2):
                more = 5 if fault == 3 else 0
                yield from go(i + 1, cost + more, audit + "K", [*out, (role, text)], 0)
                for new in ("user", "assistant"):
                    yield from go(i + 1, cost + 1 + more, audit + "R", [*out, (new, text)], 0)

    return go(0, 0, "", [], 0)


def brute(rows):
    cost, audit, out = min(all_repairs(rows), key=lambda x: x[:2])
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(40))
def test_the_least_repair_is_that_of_all(seed):
    r = random.Random(seed)
    rows = [(r.choice(["system", "user", "assistant", "assistant", "user", "tool", " "]), f"t{i}.", r.choice([0, 0, 0, 0, 1, 2, 3])) for i in range(r.randint(0, 5))]
    assert R.repair_rows(rows) == brute(rows), rows


def faults(rows):
    """Rows (turn, role, text) in order, with their first faults."""
    seen, out = set(), []
    for _, role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append((role, text, 1 if not visible else 2 if (role, text) in seen else 3 if visible[-1] not in ".!?" else 0))
        seen.add((role, text))
    return out


def expected(table):
    conversations = {}
    for conv, turn, role, text in table:
        own = conversations.setdefault(conv, [])
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        own += [(turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    out = []
    for conv, rows in conversations.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        own = faults(rows)
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        n = [sum(f == k for _, _, f in own) for k in (1, 2, 3)]
        illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:]))
        out.append((conv, gaps, *n, illegal, *brute(own)))
    return sorted(out, key=repr)


def rows_of(seed, n=60):
    r = random.Random(seed)
    out = []
    for conv in [None, -1, *range(n)]:
        for turn in range(r.randint(1, 5)):
            text = r.choice(["Hello there. ", "what?", "Why!\n", "no end", " \t\n", "", "é…", "漢字.", None, "same.", "same.", "a" * 5000 + "."])
            out.append((conv, r.choice([turn, turn, turn, turn + 3, None]), r.choice(["user", "assistant", "system", "user", "assistant", None, "tool", "", "U"]), text))
    return out + out[5:9]  # repeated rows


def got(df):
    return sorted(map(tuple, df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_every_conversation_is_that_of_plain_code(spark, seed):
    table = [x for x in rows_of(seed)]
    df = spark.createDataFrame([(*x, "x", True) for x in table], "conv_id long, turn long, role string, text string, fault string, here boolean").repartition(3)
    assert got(R.repair(R.damaged(df))) == expected(table)


def test_identifiers_of_any_type_and_an_empty_table(spark):
    df = spark.createDataFrame([("x", 0, "user", "Hi."), ("x", 1, "assistant", "Ho.")], "conv_id string, turn int, role string, text string")
    assert [r.conv_id for r in R.repair(R.damaged(df)).collect()] == ["x"]
    assert R.repair(R.damaged(df.limit(0))).collect() == []


def test_a_conversation_without_rows_left():
    assert R.repair_rows([]) == (0, "", hashlib.sha256(b"").hexdigest())


def test_a_long_conversation_needs_little(spark):
    import time

    rows = [(("user", "assistant", "user")[i % 3], f"text {i}.", 0) for i in range(60_000)]
    began = time.process_time()
    chart = R.Chart()
    for row in rows:
        chart.read(*row)
    cost, audit, _ = chart.end()
    assert len(audit) - audit.count("I") == len(rows) and cost == sum({"K": 0, "R": 1, "D": 2, "I": 5}[c] for c in audit)
    assert len(chart.column) <= len(R.NAMES) and len(chart.back) == 4 * len(rows) and time.process_time() - began < 30
