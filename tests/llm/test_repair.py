"""Conversation repair against a plain search over whole strings, and its SQL."""

import hashlib
import random

import pytest

from fleetgrain.llm import repair

from ..compare import agree

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
FOLLOW = {0: "user", 1: "user", 2: "assistant", 3: "user"}
STATE = {"user": 2, "assistant": 3}


def keeps(state, role):
    return {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], state))


def brute(rows):
    """cost, audit and repaired messages: every state's least (cost, audit), insertions tried before every edit, deletions too."""
    best = {0: (0, "", [])}

    def inserted(best):
        best = dict(best)
        for _ in range(4):
            for s, (c, a, out) in list(best.items()):
                role = FOLLOW[s]
                new = (c + 5, a + "I", [*out, (role, "")])
                if STATE[role] not in best or new[:2] < best[STATE[role]][:2]:
                    best[STATE[role]] = new
        return best

    seen, counts = set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in rows:
        must = cut = False
        if not text.strip(SPACE):
            counts["blank"] += 1
            must = True
        elif (role, text) in seen:
            counts["duplicate"] += 1
            must = True
        elif text.rstrip(SPACE)[-1] not in ".!?":
            counts["truncated"] += 1
            cut = True
        seen.add((role, text))
        after = {}
        for s, (c, a, out) in inserted(best).items():
            some = [(s, (c + 2, a + "D", out))]
            if not must:
                more = 5 if cut else 0
                if keeps(s, role) is not None:
                    some.append((keeps(s, role), (c + more, a + "K", [*out, (role, text)])))
                some.append((STATE[FOLLOW[s]], (c + 1 + more, a + "R", [*out, (FOLLOW[s], text)])))
            for t, new in some:
                if t not in after or new[:2] < after[t][:2]:
                    after[t] = new
        best = after
    best = inserted(best)
    cost, audit, out = min((best[s] for s in (0, 3) if s in best), key=lambda x: x[:2])
    return {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()} | counts


def expected(rows):
    """By conversation, of rows with a text and a role."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
        got = brute([(" " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in own])
        initials = [(" " if r[2] is None else r[2])[:1] for r in own]
        turns = [r[1] for r in own if r[1] is not None]
        got["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        got["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = got
    return out


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for conv in conversations:
        for _ in range(rng.randint(1, most)):
            rows.append((conv, rng.choice([None, *range(most)]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(["a.", "b!", "c", "d?  ", "", " \t", None, f"x{rng.randrange(9)}.", f"y{rng.randrange(9)}", f"z{rng.randrange(5000)}."])))
    return rows


def check(spark, rows):
    found = {r.conv_id: r.asDict() for r in repair.report(repair.repaired(spark.createDataFrame(rows, SCHEMA))).collect()}
    want = expected(rows)
    assert set(found) == set(want)
    for conv, w in want.items():
        assert {k: found[conv][k] for k in w} == w, conv


def test_small_conversations_equal_the_plain_search(spark):
    check(spark, random_rows(1, [None, *range(60)], 12))


def test_a_conversation_over_many_partitions_and_chunks(spark):
    check(spark, random_rows(2, [7], 6000)[:6000] + random_rows(4, [7] * 3, 6000) + random_rows(3, [1, 2, 9], 30))


def test_equal_rows_and_long_messages(spark):
    long = "word " * 400_000
    check(spark, [(1, 5, "user", "hi.")] * 3000 + [(1, 6, "assistant", long + "."), (2, 0, "user", long), (2, 1, "assistant", "no.")])


@pytest.mark.parametrize("code", range(8))
def test_no_step_begins_another(code):
    for names in repair.MESSAGES[code][2]:
        some = [n for n in names if n != "~"]
        assert not any(a != b and b.startswith(a) for a in some for b in some)


def test_no_messages(spark):
    assert repair.report(repair.repaired(spark.createDataFrame([], SCHEMA))).count() == 0


def test_a_conversation_whose_rows_are_all_dropped_stays(spark):
    dropped = [t for t in range(400) if __import__("zlib").crc32(f"3:{t}".encode()) % 20 == 0][:2]
    rows = spark.createDataFrame([(3, t, "user", "a.", 1) for t in dropped], SCHEMA + ", audit int")
    (r,) = repair.report(repair.repaired(*repair.damaged(rows))).collect()
    assert r.asDict() == {"conv_id": 3, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_query_equals_its_sql(spark, small):
    agree(repair.op11_repair(spark, small), repair.OP11_SQL, small)
