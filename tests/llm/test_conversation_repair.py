import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm.conversation_repair import apply_repairs, best_edits, damage, find_repairs, repair_report

SPACE = "\x20\t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def all_repairs(rows):
    """Every edit list of bounded cost: (cost, letters, repaired rows); rows are (role, text, fault)."""
    bound = 3 * len(rows)

    def walk(i, cost, letters, out):
        if cost > bound:
            return
        if i == len(rows) and GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in out)):
            yield cost, letters, out
        if len(letters) < 3 * len(rows) + 2:
            for role in ("user", "assistant"):
                yield from walk(i, cost + 2, letters + "I", [*out, (role, "")])
        if i < len(rows):
            role, text, fault = rows[i]
            yield from walk(i + 1, cost + 3, letters + "D", out)
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                yield from walk(i + 1, cost + extra, letters + "K", [*out, (role, text)])
                for other in ("user", "assistant"):
                    yield from walk(i + 1, cost + 2 + extra, letters + "R", [*out, (other, text)])

    return walk(0, 0, "", [])


def code(role, fault):
    return {"s": 1, "u": 2, "a": 3}.get(role[:1], 0) | {None: 0, "truncated": 4}.get(fault, 8)


ROLES = ["system", "user", "assistant", "user", "assistant", "tool", ""]


@pytest.mark.parametrize("seed", range(60))
def test_edits_against_all_edits(seed):
    r = random.Random(seed)
    rows = [(r.choice(ROLES), f"t{k}", r.choice([None, None, None, "truncated", "blank"])) for k in range(r.randint(0, 4))]
    want = min(all_repairs(rows), key=lambda x: x[:2])
    assert best_edits(bytes(code(role, fault) for role, _, fault in rows)) == want[:2]


def test_one_block_and_many_agree():
    r = random.Random(5)
    for size in [1, 2, 3, 7, 40, 300]:
        for _ in range(20):
            rows = bytes(r.choice([1, 2, 3, 2, 3, 0]) | r.choice([0, 0, 0, 4, 8]) for _ in range(size))
            whole = best_edits(rows, size)
            assert all(best_edits(rows, block) == whole for block in (1, 2, 5, 64))


def test_a_very_long_conversation():
    cost, letters = best_edits(b"\x02\x03" * 100_000)
    assert cost == 0 and letters == "K" * 200_000
    cost, letters = best_edits(b"\x02" * 30_001)
    assert cost == 30_001 + 1 and set(letters) <= set("DIKR")


def brute(rows):
    """rows: (conv_id, turn, role, text) of one conversation, before damage."""
    damaged = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    damaged.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
    if not damaged:
        return 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()
    turns = [t for t, _, _ in damaged if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    marked, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in damaged:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marked.append((role, text, fault))
    initials = [r[:1] for r, _, _ in marked]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, out = min(all_repairs(marked), key=lambda x: x[:2])
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


def table(spark, rows):
    return spark.createDataFrame([(*row, 1, "x", "y", 0) for row in rows], "conv_id long, turn long, role string, text string, kind int, hash string, audit string, part int")


def conversations():
    r, rows = random.Random(3), []
    for conv in [*range(150), None]:
        turn = r.choice([0, 0, 0, -3])
        for k in range(r.randint(1, 4)):
            role = r.choice(ROLES) if r.random() < 0.3 else ("user", "assistant")[k % 2]
            text = r.choice(["Fine.", "Well ünï 漢字!", "no stop", None, "", " \x0b\n", "Is it? \t\x0c", "\x00.", "x" * 50_000 + "."])
            rows.append((conv, None if r.random() < 0.1 else turn, None if r.random() < 0.05 else role, text))
            turn += r.choice([0, 1, 1, 1, 2])
    return rows


def test_against_brute_force(spark):
    rows, want = conversations(), {}
    for conv in {row[0] for row in rows}:
        want[conv] = brute([row for row in rows if row[0] == conv])
    df = table(spark, rows)
    got = repair_report(df, damage(df)).collect()
    assert len(got) == len(want)
    for row in got:
        assert tuple(row)[1:] == want[row.conv_id], row.conv_id
    assert any(r.audit == "" for r in got) and len({r.audit for r in got}) > 20


def test_repaired_rows_read_as_they_must(spark):
    damaged = damage(table(spark, conversations()))
    rows = apply_repairs(damaged, find_repairs(damaged)).collect()
    by_conv = {}
    for row in sorted(rows, key=lambda x: x.at):
        by_conv.setdefault(row.conv_id, []).append(row)
    assert len(by_conv) > 50
    for own in by_conv.values():
        assert [r.at for r in own] == list(range(len(own))) and GRAMMAR.fullmatch("".join(r.role[:1] for r in own))


def test_empty_table_and_other_ids(spark):
    none = table(spark, [])
    assert repair_report(none, damage(none)).count() == 0
    named = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho."), ("b", None, None, None)], "conv_id string, turn int, role string, text string")
    got = {r.conv_id: r.audit for r in repair_report(named, named).collect()}
    assert got == {"a": "KK", "b": "D"}
