"""Repair of damaged conversations: a min-plus transition for each run of equal rows, choices unrolled for the audit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import ROW, numbered, spread_lookup
from touchline.session import durable

#: costs of the edits
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: conversations with more rows or bytes are cut into pieces
LONG_ROWS, LONG_BYTES = 10_000, 16 << 20
SPACE = " \t\n\x0b\x0c\r"
NEVER = 1 << 60

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]

#: states: nothing yet, after a system turn, after a user turn, after an assistant turn
START, SYSTEM, USER, ASSISTANT = range(4)
#: where an initial leads from each state
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: the turn that a rerole or an insert gives in each state, and its state
MADE = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: symbol of a blank or duplicate row; others are twice the place of the initial in ``KINDS``, plus 1 if truncated
GONE = 8
KINDS = "sua"


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    return tuple(tuple(min(x + y for x, y in zip(row, column)) for column in zip(*b)) for row in a)


def apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(x + y for x, y in zip(row, v)) for row in a)


def _table(costs: dict[tuple[int, int], int]) -> Matrix:
    return tuple(tuple(costs.get((q, r), NEVER) for r in range(4)) for q in range(4))


_ONE = _table({**{(q, q): 0 for q in range(4)}, **{(q, MADE[q][1]): INSERT for q in range(4)}})
#: any number of inserts; none ever takes more than three
INSERTS = times(_ONE, times(_ONE, _ONE))
#: costs after the last row
END = apply(INSERTS, (0, NEVER, NEVER, 0))


@lru_cache(None)
def power(symbol: int, k: int) -> Matrix:
    """Costs of 2^k rows of one symbol, with inserts before each."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    costs = {(q, q): DELETE for q in range(4)}
    if symbol != GONE:
        more = TRUNCATED * (symbol % 2)
        for q in range(4):
            for r, cost in ((MADE[q][1], REROLE + more), (_kept(symbol, q), more)):
                if r is not None:
                    costs[q, r] = min(cost, costs.get((q, r), NEVER))
    return times(INSERTS, _table(costs))


def _kept(symbol: int, state: int) -> int | None:
    """State after keeping a row, if its role may stand here."""
    return STEPS[KINDS[symbol // 2]].get(state) if symbol < 6 else None


def through(symbol: int, n: int, after: Vector) -> Vector:
    """Costs to the end before a run of ``n`` rows, from those after it."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            after = apply(power(symbol, k), after)
    return after


def product(runs: Iterable[tuple[int, int]]) -> Matrix:
    """Costs of all runs from each state to each."""
    out = _table({(q, q): 0 for q in range(4)})
    for symbol, n in runs:
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = times(out, power(symbol, k))
    return out


def unroll(runs: tuple[tuple[int, int], ...], state: int, after: Vector, last: bool) -> tuple[str, int]:
    """Cheapest edits from ``state`` on, the ASCII-least of equal ones, and the state they end in.

    Costs at the borders of runs come from the powers; within a run one cost vector per row is filled in.
    Different edits have different initials, so the first initial that keeps the cost decides.
    """
    borders = [after]
    for symbol, n in reversed(runs):
        borders.append(through(symbol, n, borders[-1]))
    audit: list[str] = []
    for (symbol, n), end in zip(runs, borders[-2::-1]):
        costs = [end]
        for _ in range(n):
            costs.append(apply(power(symbol, 0), costs[-1]))
        more = TRUNCATED * (symbol % 2)
        for now, then in zip(costs[:0:-1], costs[-2::-1]):
            while True:
                kept = _kept(symbol, state)
                if DELETE + then[state] == now[state]:
                    audit.append("D")
                elif INSERT + now[MADE[state][1]] == now[state]:
                    audit.append("I")
                    state = MADE[state][1]
                    continue
                elif kept is not None and more + then[kept] == now[state]:
                    audit.append("K")
                    state = kept
                else:
                    audit.append("R")
                    state = MADE[state][1]
                break
    while last and state not in (START, ASSISTANT):
        audit.append("I")
        state = MADE[state][1]
    return "".join(audit), state


@lru_cache(1 << 16)
def _whole(runs: tuple[tuple[int, int], ...]) -> tuple[int, str]:
    cost = END
    for symbol, n in reversed(runs):
        cost = through(symbol, n, cost)
    return cost[START], unroll(runs, START, END, True)[0]


def collapsed(symbols: Iterable[int]) -> tuple[tuple[int, int], ...]:
    """Runs of equal symbols and their lengths."""
    return tuple((symbol, sum(1 for _ in run)) for symbol, run in groupby(symbols))


def lines(audit: Iterable[str], roles: Iterable[str], texts: Iterable[str], state: int = START) -> Iterator[tuple[bool, str]]:
    """For each edit whether it used up a row, and the line it gives, if any."""
    rows = zip(roles, texts)
    for edit in audit:
        if edit == "D":
            next(rows)
            yield True, ""
            continue
        role, to = MADE[state]
        text = ""
        if edit != "I":
            own, text = next(rows)
            if edit == "K":
                role, to = own, STEPS[own[0]][state]
        state = to
        yield edit != "I", f"{role}:{text}"


def symbol_of(role: str, fault: str | None) -> int:
    if fault in ("blank", "duplicate"):
        return GONE
    kind = KINDS.find(role[:1]) if role else -1
    return 2 * (kind if kind >= 0 else 3) + (fault == "truncated")


def faults(rows: list[tuple[str, str]]) -> list[str | None]:
    """First fault of every (role, text) of a conversation."""
    out: list[str | None] = []
    seen: set[tuple[str, str]] = set()
    for row in rows:
        bare = row[1].rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if row in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add(row)
    return out


def _legal(first: str, second: str) -> bool:
    return first + second in ("su", "ua", "au")


def repair(rows: list[tuple[int | None, str, str]]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and digest of the rows (turn, role, text) of a conversation, in order."""
    turns = {t for t, _, _ in rows if t is not None}
    said = [r[1:] for r in rows]
    found = faults(said)
    cost, audit = _whole(collapsed(symbol_of(role, fault) for (role, _), fault in zip(said, found)))
    text = "\n".join(line for (_, line), edit in zip(lines(audit, *(zip(*said) if said else ((), ()))), audit) if edit != "D")
    illegal = sum(not _legal(a[0][:1], b[0][:1]) for a, b in zip(said, said[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def _frame(**columns: Iterable) -> pd.DataFrame:
    """Columns of plain values; pandas' own string type does not always pass into Arrow."""
    return pd.DataFrame({name: pd.Series(list(values), dtype=object) for name, values in columns.items()})


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = [f.split()[0] for f in RESULT.split(", ")]
#: ascending, a null turn first
_ORDER = ["turn", "role", "text", ROW, "copy"]


def damage(conversations: DataFrame) -> DataFrame:
    """Rows after damage by the checksum of ``conv_id:turn``: dropped, emptied, without stops, twice, or said by the user.

    Dropped rows stay as marks with ``lost`` and without text, so that no conversation goes missing. ``_key`` is never null.
    """
    rows = numbered(conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")))
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind, role, text = F.col("_kind"), F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.withColumn("_kind", F.crc32(F.concat_ws(":", *named)) % 20).select(
        F.concat(F.when(F.col("conv_id").isNull(), "-").otherwise("+"), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).alias("_key"),
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when((kind == 0) | (kind == 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        ROW,
        (kind == 0).alias("lost"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _usual(rows: DataFrame) -> DataFrame:
    """Repair of conversations that one task may hold, each in one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        ids: list = []
        out: list[tuple] = []
        last = None

        def close() -> None:
            if last is not None:
                out.append(repair(held))

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for key, conv_id, turn, role, text, lost in zip(*(batch.column(c).to_pylist() for c in ("_key", "conv_id", "turn", "role", "text", "lost"))):
                if key != last:
                    close()
                    last, held = key, []
                    ids.append(conv_id)
                if not lost:
                    held.append((turn, role, text))
            if len(out) > 1000:
                yield batch_of(ids[: len(out)], out, kind)
                ids, out = ids[len(out) :], []
        close()
        if ids:
            yield batch_of(ids, out, kind)

    def batch_of(ids: list, out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(NAMES)
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["conv_id", *NAMES])

    laid = rows.repartition("_key").sortWithinPartitions("_key", *_ORDER)
    return laid.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {RESULT}")


def _long(rows: DataFrame) -> DataFrame:
    """Repair of conversations of any size, cut into pieces of the sorted rows.

    Duplicates are found by digest. Each piece gives one transition matrix; the matrices of a conversation give the
    costs after each piece, then each piece unrolls its edits from all four states and the states are chained.
    The digest of a conversation is a chain by definition, so one task streams its lines, a batch at a time.
    """
    stay = rows.where("not lost")
    same = F.unhex(F.sha2(F.concat_ws("\0", "_key", F.length("role").cast("string"), "role", "text"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", F.col(ROW).alias("row"), "copy")
    stay = stay.withColumn("_same", same)
    firsts = stay.groupBy("_same").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    stay = spread_lookup(stay, ["_same"], firsts, ROW)
    bare = F.regexp_extract("text", r"(?s)^.*[^\x20\x09-\x0D]", 0)
    fault = F.when(bare == "", "blank").when(F.col("_first").isNotNull() & ~place.eqNullSafe(F.col("_first")), "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    stay = stay.withColumn("fault", fault).withColumn("symbol", F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(2 * kind + F.coalesce((F.col("fault") == "truncated").cast("int"), F.lit(0))))
    laid = stay.repartitionByRange("_key", *_ORDER).sortWithinPartitions("_key", *_ORDER)
    laid = durable(laid.select("_key", "turn", "role", "text", "fault", "symbol", F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("at")), "laid")
    slim = laid.select("_key", "piece", "at", initial.alias("initial"), "symbol")

    def matrix(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        costs = product(collapsed(part["symbol"].tolist()))
        initials = part["initial"].tolist()
        illegal = sum(not _legal(a, b) for a, b in zip(initials, initials[1:]))
        return _frame(_key=[key[0]], piece=[key[1]], costs=[[x for row in costs for x in row]], first=[initials[0]], last=[initials[-1]], illegal=[illegal])

    pieces = durable(slim.groupBy("_key", "piece").applyInPandas(matrix, "_key string, piece int, costs array<long>, first string, last string, illegal long"), "pieces")

    def costs_after(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("piece")
        after, out = END, []
        for costs in reversed(part["costs"].tolist()):
            out.append(list(after))
            after = apply(tuple(tuple(costs[4 * q : 4 * q + 4]) for q in range(4)), after)
        illegal = int(part["illegal"].sum()) + sum(not _legal(a, b) for a, b in zip(part["last"].tolist(), part["first"].tolist()[1:]))
        n = len(part)
        return _frame(_key=[key[0]] * n, piece=part["piece"], after=out[::-1], final=[i == n - 1 for i in range(n)], cost=[after[START]] * n, illegal=[illegal] * n)

    after = durable(pieces.groupBy("_key").applyInPandas(costs_after, "_key string, piece int, after array<long>, final boolean, cost long, illegal long"), "after")

    def choices(key: tuple, part: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        runs = collapsed(part.sort_values("at")["symbol"].tolist())
        ways = [unroll(runs, q, tuple(ends["after"][0]), bool(ends["final"][0])) if ends["after"][0][q] < NEVER else ("", q) for q in range(4)]
        return _frame(_key=[key[0]] * 4, piece=[key[1]] * 4, entry=range(4), exit=[w[1] for w in ways], audit=[w[0] for w in ways])

    keys = ["_key", "piece"]
    ways = durable(slim.groupBy(*keys).cogroup(after.groupBy(*keys)).applyInPandas(choices, "_key string, piece int, entry int, exit int, audit string"), "ways")

    def chained(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        to = {(p, q): r for p, q, r in zip(part["piece"], part["entry"], part["exit"])}
        state, out = START, []
        for p in sorted(set(part["piece"])):
            out.append(state)
            state = to[p, state]
        return _frame(_key=[key[0]] * len(out), piece=sorted(set(part["piece"])), entry=out)

    entries = ways.select(*keys, "entry", "exit").groupBy("_key").applyInPandas(chained, "_key string, piece int, entry int")
    chosen = durable(ways.join(entries, [*keys, "entry"]).select(*keys, "entry", "audit"), "chosen")

    def written(key: tuple, part: pd.DataFrame, how: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        audit = how["audit"][0]
        out = [line for (_, line), edit in zip(lines(audit, part["role"], part["text"], int(how["entry"][0])), audit) if edit != "D"]
        return _frame(_key=[key[0]] * len(out), piece=[key[1]] * len(out), nth=range(len(out)), line=out)

    told = laid.select(*keys, "at", "role", "text").groupBy(*keys).cogroup(chosen.groupBy(*keys)).applyInPandas(written, "_key string, piece int, nth long, line string")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chain = None, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last]), pa.array([chain.hexdigest()])], names=["_key", "repaired_sha256"])

        for batch in batches:
            for key, line in zip(batch.column("_key").to_pylist(), batch.column("line").to_pylist()):
                if key != last:
                    if chain:
                        yield result()
                    last, chain = key, hashlib.sha256()
                else:
                    chain.update(b"\n")
                chain.update(line.encode())
        if chain:
            yield result()

    hashed = told.repartition("_key").sortWithinPartitions("_key", "piece", "nth").mapInArrow(digests, "_key string, repaired_sha256 string")
    audits = chosen.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("piece", "audit"))).alias("_parts"))
    audits = audits.select("_key", F.array_join(F.transform("_parts", lambda p: p["audit"]), "").alias("audit"))
    turns = laid.groupBy("_key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
    )
    totals = after.groupBy("_key").agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal"))
    whole = rows.groupBy("_key").agg(F.first("conv_id").alias("conv_id")).join(turns, "_key", "left").join(totals, "_key", "left").join(audits, "_key", "left").join(hashed, "_key", "left")
    none = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return whole.select("conv_id", *(F.coalesce(n, F.lit(none.get(n, 0))).alias(n) for n in NAMES))


def repaired(conversations: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Damage, faults, cheapest repair and its audit for every conv_id of (conv_id, turn, role, text).

    Faults and edits have the costs of this module; the repaired roles are an optional system turn and pairs of user and
    assistant, or nothing. A null conv_id is a conversation like any other; null roles and texts are one space; rows of
    equal turn are taken by role, text and place in the table. A conversation that lost all rows, or all of whose rows
    are deleted, has the digest of the empty string. An empty table gives an empty result; further columns are left out.
    Conversations over ``long_rows`` rows or ``long_bytes`` bytes are repaired in pieces, with the same result.
    """
    rows = damage(conversations)
    sizes = rows.groupBy("_key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    long_ = durable(sizes.where((F.col("n") > long_rows) | (F.col("size") > long_bytes)).select("_key", F.lit(True).alias("_long")), "long")
    if long_.isEmpty():
        return _usual(rows)
    rows = durable(spread_lookup(rows, ["_key"], long_, ROW), "turns")
    return _usual(rows.where("_long is null").drop("_long")).unionByName(_long(rows.where("_long").drop("_long")))
