"""Conversation repair against an exhaustive search."""

import collections
import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from touchline.llm import turn_checks, turns
from touchline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_damage(rows):
    """Conversations of (conv_id, turn, role, text), damaged and in order."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def plain_repair(rows):
    said, found = set(), []
    for _, role, text in rows:
        bare = re.sub("[\x20\x09-\x0d]+$", "", text)
        found.append("blank" if not bare else "duplicate" if (role, text) in said else "truncated" if bare[-1] not in ".!?" else "")
        said.add((role, text))

    @lru_cache(None)
    def best(i, shown, more):
        """Cheapest (cost, audit) from row i on; ``shown`` is the last initial, ``more`` bounds the inserts in a row."""
        options = []
        if i == len(rows):
            if shown in ("", "a"):
                options.append((0, "", ()))
        else:
            _, role, text = rows[i]
            cost, audit, out = best(i + 1, shown, 3)
            options.append((cost + 2, "D" + audit, out))
            if found[i] not in ("blank", "duplicate"):
                extra = 5 * (found[i] == "truncated")
                for edit, cost_of, name in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if name and shown + name[0] in ("s", "u", "su", "ua", "au"):
                        cost, audit, out = best(i + 1, name[0], 3)
                        options.append((cost + cost_of + extra, edit + audit, (f"{name}:{text}", *out)))
        if more:
            for name in ("user", "assistant"):
                if shown + name[0] in ("u", "su", "ua", "au"):
                    cost, audit, out = best(i, name[0], more - 1)
                    options.append((cost + 5, "I" + audit, (f"{name}:", *out)))
        return min(options, default=(10**9, "", ()))

    cost, audit, out = best(0, "", 3)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain(rows):
    return {c: plain_repair(tuple(r)) for c, r in plain_damage(rows).items()}


def found(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_conversations(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    got = found(QUERIES["op12_conversations"](spark, SF))
    assert got == plain(rows) and {e for r in got.values() for e in r[6]} >= set("DKR")


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    out = []
    for conv in range(conversations):
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Same?", "", " \n", None, f"number {turn}!", "é ü.\n "])
            out.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("long_rows", [10_000, 3])
def test_random_conversations(spark, long_rows):
    """Whole and in pieces; several pieces for the longest ones."""
    rows = random_rows(long_rows, 60, 14) + [(None, t, r, "One more.") for t, r in enumerate(["assistant", "user", "assistant"] * 20)]
    got = found(turns.repaired(spark.createDataFrame(rows, SCHEMA).repartition(5), long_rows=long_rows))
    assert got == plain(rows)


def test_sql_agrees_on_random_conversations(tmp_path):
    """The checking SQL itself against the exhaustive search."""
    rows = random_rows(9, 40, 9) + [(None, 2, "assistant", "Odd."), (None, 1, "user", "Even")]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = {r[0]: tuple(r[1:]) for r in con.sql(turn_checks.repair_sql()).fetchall()}
    assert got == plain(rows)


def test_powers_are_repeated_steps():
    for symbol in range(9):
        costs = turns.END
        for n in range(1, 40):
            costs = turns.apply(turns.power(symbol, 0), costs)
            assert turns.through(symbol, n, turns.END) == costs == turns.apply(turns.product([(symbol, n)]), turns.END)
        half, state = turns.unroll(((symbol, 17),), turns.START, turns.through(symbol, 22, turns.END), False)
        rest, _ = turns.unroll(((symbol, 22),), state, turns.END, True)
        assert half + rest == turns.unroll(((symbol, 39),), turns.START, turns.END, True)[0]


def test_conversations_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turns.repaired(empty).count() == 0
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Gone."), (5, None, None, None), (6, 1, "user", "long text. " * 200_000), (6, 2, "assistant", "Right.")]
    wide = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", lost string, _key int, copy int")
    got = found(turns.repaired(wide))
    assert got == plain(rows) and got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert collections.Counter(found(turns.repaired(wide, long_rows=0))) == collections.Counter(got)
