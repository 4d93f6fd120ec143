"""Conversation repair against searching all edits, with whole audit strings."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

from civicmill.llm import queries
from civicmill.llm.repair import Machine, damaged, repair

SPACE = " \t\n\x0b\x0c\r"
KIND = "conv_id long, turn long, role string, text string, audit string, times int, part string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        role, text = show(role), show(text)
        how = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, turns) over every way of editing; states are the roles' initials read so far, reduced to what may follow."""
    best = {"": (0, "", ())}
    legal = re.compile(r"s?(ua)*u?$")

    def inserted(ways):
        for a, (cost, audit, turns) in ways.items():
            for new in ("", "u", "a", "ua", "au", "uau", "aua"):
                if legal.match(a + new):
                    yield (a + new)[-1:], a + new, cost + 3 * len(new), audit + "I" * len(new), turns + tuple({"u": "user:", "a": "assistant:"}[c] for c in new)

    def least(found):
        out = {}
        for state, way in found:
            out[state] = min(out.get(state, way), way)
        return out

    short = lambda a: a if a in ("", "s") else "u" if a[-1] == "u" else "ua"
    for role, text, fault in rows:
        found = []
        for _, a, cost, audit, turns in inserted(best):
            found.append((short(a), (cost + 4, audit + "D", turns)))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if role and legal.match(a + role[0]) and role[0] in "sua":
                found.append((short(a + role[0]), (cost + more, audit + "K", (*turns, f"{role}:{text}"))))
            for new in ("user", "assistant"):
                if legal.match(a + new[0]):
                    found.append((short(a + new[0]), (cost + more + 3, audit + "R", (*turns, f"{new}:{text}"))))
        best = least(found)
    return min((cost, audit, turns) for _, a, cost, audit, turns in inserted(best) if re.fullmatch("(s?(ua)+)?", a))


def expected(ids, rows):
    out = []
    md5 = lambda r: hashlib.md5(f"{r[2]}\0{r[3]}".encode()).hexdigest()
    for conv in set(ids):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, md5(r)))
        seen, faulty = set(), []
        for _, _, role, text in own:
            fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "" if text.rstrip(SPACE)[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {r[1] for r in own if r[1] is not None}
        n = lambda kind: sum(f == kind for *_, f in faulty)  # noqa: B023, E731
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        cost, audit, kept = cheapest(faulty)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **sizes):
    frame = spark.createDataFrame([(*r, "x", 0, "y") for r in rows], KIND)
    return sorted((tuple(r) for r in repair(damaged(frame), **sizes).collect()), key=str)


def made(seed: int, n: int, most: int):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "Why? ", "", " \t", "é.", "a.b", "Yes."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "Assistant", None]
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            out.append((conv if conv else None, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(roles), rng.choice([*texts, f"Say {rng.random()}.", f"Say {rng.random()}.", None])))
    return out


def test_small_conversations(spark):
    rows = made(1, 150, 9) + [(900, t, "user", "x" * 100_000 + ".") for t in range(3)] + [(901, 5, "user", "Same."), (901, 5, "user", "Same."), (901, 5, "user", "Same.")]
    assert got(spark, rows) == expected([r[0] for r in rows], damage(rows))
    assert got(spark, rows[:0]) == []


def test_long_conversations(spark):
    """Conversations over many segments and partitions, one of them with most rows."""
    rows = made(2, 12, 40) + [(77, i // 2, ["user", "assistant"][i % 2] if i % 11 else "system", f"Turn {i % 150}" + (".", "")[i % 13 == 0]) for i in range(700)] + [(78, None, "user", "Again.")] * 60
    want = expected([r[0] for r in rows], damage(rows))
    assert got(spark, rows, segment_rows=7) == want
    assert got(spark, rows, segment_chars=60) == want


def test_nothing_left(spark):
    gone = next((c, t) for c in range(100) for t in range(100) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert got(spark, [(*gone, "user", "Hello.")]) == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_layers_are_few():
    """Costs from the least and dense ranks: a long conversation meets no new layers after a while."""
    rng, machine = random.Random(4), Machine()
    kinds = [r + f for r in "sua?" for f in "bdts"]
    machine.run([rng.choice(kinds) for _ in range(20_000)], 0)
    known = len(machine.known)
    machine.run([rng.choice(kinds) for _ in range(20_000)], 0)
    assert len(machine.known) <= known * 1.1 + 5 and known < 2_000


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = sorted((tuple(r) for r in queries.op12_repair(spark, sf).collect()), key=str)
    assert found == expected([r[0] for r in rows], damage(rows))
