"""Repair of damaged conversations by one integer minimum per step.

A conversation must read ``(s?(ua)+)?`` by the initials of its roles, without
blank or repeated rows. Edits keep a row (0), give it another role (2), delete it
(3) or insert an empty row (2); a truncated row that stays adds 1. Of all
cheapest repairs the one whose letters D, I, K, R read least in ASCII order counts.

Both aims are one whole number. Its high digits are the cost. Its low digits, a
fixed number of them, are the letters from the first place on, three bits each in
ASCII order, with zeros behind the last letter, so a shorter string comes before a
longer one that begins with it. A shortest-path recurrence from the last row to
the first over the four states of the pattern then takes plain minima of numbers.

Long conversations are cut into blocks of rows, worked from the last to the first.
What follows a block enters as a cost per state. That is exact: an insertion belongs to
the row behind it, so no two ways through a block are one the beginning of the
other, and their own letters decide between them. Numbers have a fixed width, and the
time grows with the number of rows.

Rows meet by conversation twice, both times streamed in order: first without
their texts, to find the edits, then with them, to write the repaired rows. Of a
conversation a task holds one byte per row, its letters, and 16 bytes per distinct row.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.words import batches
from tidemark.staging import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
LETTERS = ["", "D", "I", "K", "R"]  # in ASCII order; a place without a letter is 0
_D, _I, _K, _R = 1, 2, 3, 4
_BITS = 3
BLOCK_ROWS = 128

# States: nothing yet, after a system row, after a user row, after an assistant row.
_STATES = range(4)
_NEXT = (2, 2, 3, 2)  # state after the role that the pattern wants, user or assistant
_WANTED = ("user", "user", "assistant", "user")
_COMPLETE = (True, False, False, True)
# A row as one byte: 1 for s, 2 for u, 3 for a, 0 for others; 4 if truncated, 8 if it must go.
_INITIALS = {"s": 1, "u": 2, "a": 3}
_MUST_GO, _CUT_OFF = 8, 4


def _after_keeping(state: int, initial: int) -> int | None:
    if initial == 1:
        return 1 if state == 0 else None
    return _NEXT[state] if initial == _NEXT[state] else None


def _block(rows: bytes, after: list[int | None]) -> list[tuple[int, str, int] | None]:
    """Per state before the rows: (cost, letters, state behind) of the best way through them.

    ``after`` is the cost of what follows per state. Every way ends with the edit of the last row.
    """
    # In a best way no more than two rows are inserted at one place: a third comes back to the state of the first.
    places = 3 * len(rows)
    top = _BITS * places
    first = [digit << (top - _BITS) for digit in range(5)]

    def put(cost: int, digit: int, rest: int) -> int:
        high = rest >> top
        return (high + cost << top) + first[digit] + ((rest - (high << top)) >> _BITS)

    best: list[tuple[int, int] | None] = [None if cost is None else (cost << top, state) for state, cost in enumerate(after)]
    for row in reversed(rows):
        initial, extra = row & 3, TRUNCATED if row & _CUT_OFF else 0
        edited: list[tuple[int, int] | None] = []
        for state in _STATES:
            ways = []
            if best[state]:
                ways.append((put(DELETE, _D, best[state][0]), best[state][1]))
            if not row & _MUST_GO:
                kept = _after_keeping(state, initial)
                if kept is not None and best[kept]:
                    ways.append((put(KEEP + extra, _K, best[kept][0]), best[kept][1]))
                if best[_NEXT[state]]:
                    ways.append((put(REROLE + extra, _R, best[_NEXT[state]][0]), best[_NEXT[state]][1]))
            edited.append(min(ways, default=None))
        best = []
        for state in _STATES:
            one, two = _NEXT[state], _NEXT[_NEXT[state]]
            ways = [edited[state]] if edited[state] else []
            if edited[one]:
                ways.append((put(INSERT, _I, edited[one][0]), edited[one][1]))
            if edited[two]:
                ways.append((put(INSERT, _I, put(INSERT, _I, edited[two][0])), edited[two][1]))
            best.append(min(ways, default=None))
    out = []
    for way in best:
        if way is None:
            out.append(None)
            continue
        number, end = way
        digits = number & ((1 << top) - 1)
        letters = "".join(LETTERS[digits >> shift & 7] for shift in range(top - _BITS, -1, -_BITS))
        out.append(((number >> top) - after[end], letters, end))
    return out


def _plan(rows: bytes, block_rows: int) -> tuple[int, str]:
    # Behind the last row only insertions are left.
    tails = ["" if _COMPLETE[s] else "I" if _COMPLETE[_NEXT[s]] else "II" for s in _STATES]
    after: list[int | None] = [INSERT * len(tail) for tail in tails]
    if not rows:
        return after[0], tails[0]
    blocks = []
    for start in range((len(rows) - 1) // block_rows * block_rows, -1, -block_rows):
        ways = _block(rows[start : start + block_rows], after)
        blocks.append(ways)
        after = [None if way is None else way[0] + after[way[2]] for way in ways]
    state, letters = 0, []
    for ways in reversed(blocks):
        _, own, state = ways[state]
        letters.append(own)
    return after[0], "".join([*letters, tails[state]])


_short_plan = lru_cache(1 << 14)(_plan)


def best_edits(rows: bytes, block_rows: int = BLOCK_ROWS) -> tuple[int, str]:
    """(cost, letters) of the best repair of a conversation given as one byte per row."""
    return (_short_plan if len(rows) <= 32 else _plan)(rows, block_rows)


def repaired(rows: Iterator[tuple[str, str]], letters: str) -> Iterator[tuple[str, str]]:
    """The rows (role, text) with the edits applied."""
    rows, state = iter(rows), 0
    for letter in letters:
        if letter == "I":
            state, role, text = _NEXT[state], _WANTED[state], ""
        else:
            role, text = next(rows)
            if letter == "D":
                continue
            if letter == "R":
                state, role = _NEXT[state], _WANTED[state]
            else:
                state = 1 if role[:1] == "s" else _NEXT[state]
        yield role, text


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """The rows conv_id, turn, role, text after damage that follows from conv_id and turn alone.

    Of twenty values of a checksum of both, 0 drops the row, 1 empties its text,
    2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. A
    NULL counts as one space.
    """
    kind = F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", _or_space("role").alias("role"), _or_space("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _by_conversation(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Streams the rows of each conversation; the rows arrive in order."""
    rows = (row for batch in source for row in zip(*(column.to_pylist() for column in batch.columns)))
    return itertools.groupby(rows, key=lambda row: row[0])


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def find_repairs(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows of a conversation go by turn, NULL first, equal turns by role and by the
    hash of the text. Each row's first fault counts: blank, seen before with the same
    role, text without a stop at its end. ``gaps`` are missing turns between the
    first and the last, ``illegal`` the neighbours whose initials are not su, ua
    or au, ``audit`` the letters of the best edits. Rows without conv_id are one
    conversation; a NULL role or text counts as one space. Needs conv_id, turn, role and text.
    """
    text = _or_space("text")
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    ended = text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    narrow = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), _or_space("role").alias("role"), _hash(text).alias("hash"),
        F.when(blank, "blank").when(~ended, "truncated").alias("fault"),
    )
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, keys, audits = [], [], []
        for key, group in _by_conversation(source):
            counts, codes, seen = dict.fromkeys(_COUNTS, 0), bytearray(), set()
            first, last, distinct, before = None, None, 0, None
            for _, turn, role, text_hash, fault in group:
                row_id = hashlib.blake2b(text_hash + role.encode(), digest_size=16).digest()
                if fault != "blank" and row_id in seen:
                    fault = "duplicate"
                seen.add(row_id)
                if fault:
                    counts[fault] += 1
                if turn is not None:
                    distinct += turn != last
                    first, last = turn if first is None else first, turn
                if before is not None and before + role[:1] not in ("su", "ua", "au"):
                    counts["illegal"] += 1
                before = role[:1]
                codes.append(_INITIALS.get(before, 0) | (_MUST_GO if fault in ("blank", "duplicate") else _CUT_OFF if fault else 0))
            counts["gaps"] = last - first + 1 - distinct if distinct else 0
            counts["cost"], audit = best_edits(bytes(codes))
            keys.append(key)
            found.append([counts[c] for c in _COUNTS])
            audits.append(audit)
            if len(keys) >= 5000:
                yield result(keys, found, audits)
                found, keys, audits = [], [], []
        if keys:
            yield result(keys, found, audits)

    def result(keys: list, found: list, audits: list) -> pa.RecordBatch:
        columns = {c: pa.array(values, pa.int64()) for c, values in zip(_COUNTS, zip(*found))}
        return batches({"conv_id": pa.array(keys, key_type), **columns, "audit": pa.array(audits, pa.string())})

    key_type = to_arrow_type(rows.schema["conv_id"].dataType)
    ddl = f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string"
    return _in_order(narrow, "turn", "role", "hash").mapInArrow(run, ddl)


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def apply_repairs(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired rows of the conversations in ``repairs``: conv_id, at (from 0), role, text."""
    return _written(rows, repairs, lambda letters, group: (
        {"at": at, "role": role, "text": text} for at, (role, text) in enumerate(repaired(group, letters))
    ), {"at": pa.int64(), "role": pa.string(), "text": pa.string()}, "at long, role string, text string")


def repaired_digests(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): hash of the repaired rows as ``role:text`` lines."""

    def digest(letters: str, group: Iterator[tuple[str, str]]) -> Iterator[dict]:
        whole, line = hashlib.sha256(), ""
        for role, text in repaired(group, letters):
            whole.update(f"{line}{role}:{text}".encode())
            line = "\n"
        yield {"repaired_sha256": whole.hexdigest()}

    return _written(rows, repairs, digest, {"repaired_sha256": pa.string()}, "repaired_sha256 string")


def _written(rows: DataFrame, repairs: DataFrame, write, types: dict[str, pa.DataType], ddl: str) -> DataFrame:
    """What ``write`` makes of the letters and the rows of each conversation; the letters come as a row before the others."""
    text = _or_space("text")
    all_rows = rows.select(
        "conv_id", F.lit(1).alias("part"), F.col("turn").cast("long").alias("turn"), _or_space("role").alias("role"), _hash(text).alias("hash"), text.alias("text"),
    )
    none = F.lit(None)
    plans = repairs.select(
        "conv_id", F.lit(0).alias("part"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("hash"), F.col("audit").alias("text"),
    )
    key_type = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, made, size = [], [], 0
        for key, group in _by_conversation(source):
            _, part, *_, letters = next(group)
            if part:  # no plan for this conversation
                continue
            for row in write(letters, ((role, text) for *_, role, _, text in group)):
                keys.append(key)
                made.append(row)
                size += sum(len(v) for v in row.values() if isinstance(v, str)) + 64
                if size >= 4 << 20:
                    yield result(keys, made)
                    keys, made, size = [], [], 0
        if keys:
            yield result(keys, made)

    def result(keys: list, made: list[dict]) -> pa.RecordBatch:
        return batches({"conv_id": pa.array(keys, key_type), **{c: pa.array([row[c] for row in made], kind) for c, kind in types.items()}})

    ordered = _in_order(all_rows.unionByName(plans), "part", "turn", "role", "hash")
    return ordered.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {ddl}")


def repair_report(original: DataFrame, damaged: DataFrame) -> DataFrame:
    """Per conversation of ``original``: what is wrong with its damaged rows, and their best repair.

    Conversations without a row after damage have zeros, no edits and the hash of
    nothing. An empty table gives an empty result; repeated rows are rows of
    their own; columns other than conv_id, turn, role and text are ignored.
    """
    repairs = stage(find_repairs(damaged), "repairs")
    digests = repaired_digests(damaged, repairs)
    every = original.select("conv_id").distinct().alias("e")
    r, d = repairs.alias("r"), digests.alias("d")
    joined = every.join(r, F.col("e.conv_id").eqNullSafe(F.col("r.conv_id")), "left").join(d, F.col("e.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    return joined.select(
        "e.conv_id", *[F.coalesce(f"r.{c}", F.lit(0).cast("long")).alias(c) for c in _COUNTS], F.coalesce("r.audit", F.lit("")).alias("audit"),
        F.coalesce("d.repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_report(conversations, damage(conversations))


QUERIES = {"op11_conversation_repair": (op11_conversation_repair, None)}
