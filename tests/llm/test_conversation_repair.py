"""Conversation repair against an exhaustive parse and a row-by-row model."""

import hashlib
import random
import zlib

import pytest

from conftest import SF_MID
from freshstream.llm import conversation_repair as R
from freshstream.llm.queries import QUERIES

WHITE = " \t\n\x0b\x0c\r"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit, lines) by trying, per row, every edit on every ending."""
    def inserted(now):
        now, todo = dict(now), list(now)
        while todo:
            end = todo.pop()
            cost, audit, lines = now[end]
            for t in set("ua") & set(NEXT[end]):
                new = (cost + 3, audit + "I", (*lines, ("user" if t == "u" else "assistant") + ":"))
                if t not in now or new[:2] < now[t][:2]:
                    now[t] = new
                    todo.append(t)
        return now

    now = {"": (0, "", ())}
    for role, text, must_go, truncated in rows:
        after = {}

        def put(end, cost, audit, lines):
            if end not in after or (cost, audit) < after[end][:2]:
                after[end] = (cost, audit, lines)

        for end, (cost, audit, lines) in inserted(now).items():
            put(end, cost + 4, audit + "D", lines)
            if not must_go:
                extra = 3 if truncated else 0
                if role[:1] and role[:1] in NEXT[end]:
                    put(role[:1], cost + extra, audit + "K", (*lines, f"{role}:{text}"))
                for t in set("ua") & set(NEXT[end]):
                    name = "user" if t == "u" else "assistant"
                    put(t, cost + 3 + extra, audit + "R", (*lines, f"{name}:{text}"))
        now = after
    return min(v for end, v in inserted(now).items() if end in ("", "a"))


def model(table):
    """The contract, one conversation at a time."""
    convs, out = {}, {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            body = text.rstrip(WHITE)
            fault = ("blank" if not body else "duplicate" if (role, text) in seen
                     else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        initials = [r[1][:1] for r in rows]
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, lines = cheapest(judged)
        out[conv] = {**counts, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                     "cost": cost, "audit": audit,
                     "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    return out


def compare(spark, workdir, table, block=None, monkeypatch=None):
    spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string").repartition(3) \
        .write.parquet(f"{workdir}/conversations.parquet")
    rows = QUERIES["op12_conversation_repair"](spark, workdir).collect()
    want = model(table)
    assert len(rows) == len(want)
    for r in rows:
        got = r.asDict()
        assert {k: v for k, v in got.items() if k != "conv_id"} == want[got["conv_id"]], got["conv_id"]


def made_rows(seed, n):
    rnd = random.Random(seed)
    texts = ["Yes.", "No", " \t", "", "Why?", "Well. ", "so\n", None, "a" * 3000 + "!", "é.\x0b"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "user", "assistant"]
    return [(rnd.choice([None, *range(40)]), rnd.choice([None, *range(12)]), rnd.choice(roles), rnd.choice(texts))
            for _ in range(n)]


def test_states_of_the_role_grammar():
    assert len(R.every_stack()) == 6 and R.every_stack()[0] == (0,)


@pytest.mark.parametrize("block", [1, 2, 5, 1000])
def test_blocks_compose_to_the_cheapest_edits(block):
    rnd = random.Random(block)
    for _ in range(400):
        rows = [(rnd.choice(["s", "u", "a", "t", ""]), rnd.random() < .15, rnd.random() < .1, rnd.random() < .3,
                 rnd.choice([1, 1, 1, 3])) for _ in range(rnd.randint(0, 10))]
        single = [(i, "x", b or d or k > 0, t) for i, b, d, t, n in rows for k in range(n)]
        cut = [rows[i:i + block] for i in range(0, len(rows), block)]
        ways = [R.parse_block(c, R.every_stack() if i else [(0,)]) for i, c in enumerate(cut)]
        assert R.compose(ways) == cheapest(single)[:2]


def test_query_equals_model_on_made_rows(spark, workdir):
    """NULLs in every column, ties and repeated rows, odd roles, long texts."""
    compare(spark, workdir, made_rows(3, 900))


def test_one_long_conversation_is_parsed_in_blocks(spark, workdir):
    rnd = random.Random(7)
    rows = [(5, t, rnd.choice(["user", "assistant", "assistant", "tool"]), rnd.choice(["A.", "B!", "c", f"{t}?"]))
            for t in range(1500)]
    compare(spark, workdir, rows + [(6, 0, "user", "x.")])


def test_query_equals_model_on_the_given_table(spark, workdir):
    given = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/conversations.parquet")
             .select("conv_id", "turn", "role", "text").collect()]
    compare(spark, workdir, given)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert R.audits(R.conversation_rows(empty)).count() == 0
    one = spark.createDataFrame([("c", 1, "user", "Hi.", 9, "x"), ("c", 2, "assistant", "Ho.", 9, "x")],
                                "c string, t int, role string, body string, copies int, audit string")
    rows = R.conversation_rows(one, "c", "t", "role", "body")
    found = R.audits(rows)
    assert [tuple(r) for r in found.collect()] == [("c", 0, 0, 0, 0, 0, 0, "KK")]
    assert [(r.position, r.role, r.text, r.edit) for r in R.repaired(rows, found).collect()] == [
        (0, "user", "Hi.", "K"), (1, "assistant", "Ho.", "K")]
