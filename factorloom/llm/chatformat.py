"""Chat formatting with a repair of the turn order at minimum cost.

A legal conversation is an optional system turn, then user and assistant turns by turns, ending with an
assistant's.  Dynamic programming over this automaton chooses for every turn whether it stays, takes another
role or is merged into the turn before it, and where an empty turn is put in; the sum of the costs is least,
and among equal costs the first choice in the fixed order of the moves wins.  Each turn is then rendered, and the
rendered parts of a conversation in order are its text.

Long conversations are cut into blocks of turns.  A block's least costs from every state to every state are a
small matrix.  The matrices are combined in two levels: blocks lie in ranges of (conversation, block) of about equal
size, one matrix a conversation and range is carried over the ranges, and within a range each block gets its first
and last state; then the choices are made block by block.  So no task holds a conversation, or all its blocks, as a
whole: one conversation's records of the upper level are no more than there are ranges.

Turns are ordered by number (null first), then by a hash of role and text.  A repeated row (same conversation,
number, role and text) counts once.  Null texts are empty; unknown and null roles must take another role.  A row
without conversation id is a conversation of its own.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.textunits import bounded_batches, id_type
from factorloom.plans.rangescan import RANGE, cut_into_ranges
from factorloom.plans.staging import stage

BLOCK_TURNS = 512
ROLES = ("system", "user", "assistant")
#: Roles that may follow a state; a state is the role of the last turn, or START.
START = 3
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
LAST = 2
MERGE, RELABEL, NAME, INSERT = 2, 4, 3, 5
FAR = 1 << 30
#: Cost of what cannot be reached, over many blocks; the sum of two such still fits.
UNREACHED = 1 << 60


def _moves() -> list[list[tuple[int, int, int, tuple[int, ...], str]]]:
    """For each given role (3: unknown) the moves (from, to, cost, inserted roles, action), in order of preference."""
    paths = {}
    for state in range(4):  # a chain of at most two empty turns reaches every state
        paths[state] = [((), state)]
        for first in NEXT[state]:
            paths[state].append(((first,), first))
            paths[state] += [((first, second), second) for second in NEXT[first]]
    moves = []
    for given in range(4):
        known = []
        for state, role in product(range(4), range(3)):
            change = 0 if role == given else NAME if given == 3 else RELABEL
            action = "keep" if role == given else "relabel"
            for inserted, reached in paths[state]:
                if role in NEXT[reached]:
                    known.append((len(inserted) * INSERT + change, state, role, inserted, action))
            if state == role:
                known.append((MERGE + change, state, role, (), "merge"))
        known.sort(key=lambda m: (m[0], m[3], m[4], m[1], m[2]))
        moves.append([(s, r, c, i, a) for c, s, r, i, a in known])
    return moves


MOVES = _moves()


def closing(state: int) -> tuple[int, tuple[int, ...]]:
    """Cost and inserted roles that end a conversation after a state."""
    inserted = []
    while state != LAST:
        state = 1 if state in (START, 0) else 2
        inserted.append(state)
    return len(inserted) * INSERT, tuple(inserted)


def block_costs(given: list[int]) -> np.ndarray:
    """Least cost from every state before a block to every state after it."""
    best = np.full((4, 4), FAR)
    np.fill_diagonal(best, 0)
    for role in given:
        after = np.full((4, 4), FAR)
        for state, to, cost, _, _ in MOVES[role]:
            np.minimum(after[:, to], best[:, state] + cost, out=after[:, to])
        best = np.minimum(after, FAR)
    return best


def block_choices(given: list[int], first: int, last: int) -> list[tuple[int, tuple[int, ...], str]]:
    """The cheapest moves (role, inserted, action) from one state to another."""
    best, came = [FAR] * 4, []
    best[first] = 0
    for role in given:
        after, by = [FAR] * 4, [None] * 4
        for move in MOVES[role]:
            cost = best[move[0]] + move[2]
            if cost < after[move[1]]:
                after[move[1]], by[move[1]] = cost, move
        best = after
        came.append(by)
    choices, state = [], last
    for by in reversed(came):
        before, to, _, inserted, action = by[state]
        choices.append((to, inserted, action))
        state = before
    return choices[::-1]


def _opened(role: int, text: str = "") -> str:
    return f"<|im_start|>{ROLES[role]}\n{text}"


CLOSED = "<|im_end|>\n"


def rendered_part(state: int, role: int, inserted: tuple[int, ...], action: str, text: str, ends: bool) -> str:
    """Text that one turn adds: the end of the turn before it, empty turns, its own head and content."""
    if action == "merge":
        part = "\n" + text
    else:
        part = "" if state == START else CLOSED
        part += "".join(_opened(r) + CLOSED for r in inserted) + _opened(role, text)
    if ends:
        part += CLOSED + "".join(_opened(r) + CLOSED for r in closing(role)[1])
    return part


def _groups(batches, width: int = 2):
    """Rows of each group of a partition that is ordered by its first columns, as (key, rows)."""
    key, rows = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            if row[:width] != key:
                if rows:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row)
    if rows:
        yield key, rows


def _gathered(records, size: int = 2000):
    """Small records as batches of at least so many rows."""
    held, count = [], 0
    for record in records:
        held.append(record)
        count += record.num_rows
        if count >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, count = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _block_matrix(values: list[int]) -> np.ndarray:
    matrix = np.array(values).reshape(4, 4)
    return np.where(matrix >= FAR, UNREACHED, matrix)


def _then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Least costs over two steps; ``first`` is a matrix or one row of it."""
    return np.minimum((first[..., :, None] + second).min(-2), UNREACHED)


def _before(vectors: list[np.ndarray], matrices: list[np.ndarray], last: int) -> list[int]:
    """The state before each step on the cheapest way to ``last``; of equal ones the first state."""
    found = []
    for vector, matrix in zip(reversed(vectors), reversed(matrices), strict=True):
        last = int(np.argmin(vector + matrix[:, last]))
        found.append(last)
    return found[::-1]


def _steps(vector: np.ndarray, matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Least cost of every state before each step, and after the last one."""
    vectors = [vector]
    for matrix in matrices:
        vectors.append(_then(vectors[-1], matrix))
    return vectors


def range_costs(batches):
    """One matrix a conversation and range, from the matrices of its blocks in order."""
    for (conv, number), held in _groups(batches):
        whole = _block_matrix(held[0][3])
        for row in held[1:]:
            whole = _then(whole, _block_matrix(row[3]))
        yield pa.record_batch([pa.array([conv]), pa.array([number], pa.int32()), pa.array([whole.ravel().tolist()])], ["conv", RANGE, "costs"])


def range_starts(batches):
    """The costs with which a conversation enters each of its ranges."""
    for (conv,), held in _groups(batches, 1):
        vector = np.full(4, UNREACHED)
        vector[START] = 0
        entered = _steps(vector, [np.array(r[2]).reshape(4, 4) for r in held])[:-1]
        yield pa.record_batch(
            [pa.array([conv] * len(held)), pa.array([r[1] for r in held], pa.int32()), pa.array([v.tolist() for v in entered])],
            ["conv", RANGE, "entered"],
        )


def range_ways(batches):
    """For every state after a range the state before it, and the costs after the range."""
    for (conv, number), held in _groups(batches):
        matrices = [_block_matrix(r[3]) for r in held]
        vectors = _steps(np.array(held[0][4]), matrices)
        ways = [_before(vectors[:-1], matrices, state)[0] for state in range(4)]
        yield pa.record_batch(
            [pa.array([conv]), pa.array([number], pa.int32()), pa.array([ways]), pa.array([vectors[-1].tolist()])],
            ["conv", RANGE, "ways", "reached"],
        )


def range_ends(batches):
    """The state after each range of a conversation, and whether it is the last one."""
    for (conv,), held in _groups(batches, 1):
        state = int(np.argmin([held[-1][3][s] + closing(s)[0] for s in range(4)]))
        states = []
        for row in reversed(held):
            states.append(state)
            state = row[2][state]
        final = [False] * (len(held) - 1) + [True]
        yield pa.record_batch(
            [pa.array([conv] * len(held)), pa.array([r[1] for r in held], pa.int32()), pa.array(states[::-1], pa.int32()), pa.array(final)],
            ["conv", RANGE, "state", "final"],
        )


def block_spans(batches):
    """The states before and after each block, and whether the conversation ends with it."""
    for (conv, _), held in _groups(batches):
        matrices = [_block_matrix(r[3]) for r in held]
        first = _before(_steps(np.array(held[0][4]), matrices)[:-1], matrices, held[0][5])
        last = [*first[1:], held[0][5]]
        final = [False] * (len(held) - 1) + [held[0][6]]
        yield pa.record_batch(
            [pa.array([conv] * len(held)), pa.array([r[2] for r in held]), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(final)],
            ["conv", "block", "first", "last", "ends"],
        )


def _combined(matrices: DataFrame, count: int) -> DataFrame:
    """Rows (conv, block, first, last, ends) from the matrices (conv, block, costs) of the blocks."""
    cut = cut_into_ranges(matrices, ["conv"], ["block"])

    def by_range(table: DataFrame, *more: str) -> DataFrame:
        ordered = table.repartition(count, "conv", RANGE).sortWithinPartitions("conv", RANGE, "block")
        return ordered.select("conv", RANGE, "block", "costs", *more)

    def by_conversation(table: DataFrame) -> DataFrame:
        return table.repartition(count, "conv").sortWithinPartitions("conv", RANGE)

    def run(table: DataFrame, step, columns: str) -> DataFrame:
        return stage(table.mapInArrow(lambda b: _gathered(step(b)), columns), "chat-ranges")

    key = ["conv", RANGE]
    head = f"conv string, {RANGE} int"
    costs = run(by_range(cut), range_costs, f"{head}, costs array<long>")
    starts = run(by_conversation(costs), range_starts, f"{head}, entered array<long>")
    entered = cut.join(starts, key)
    ways = run(by_range(entered, "entered"), range_ways, f"{head}, ways array<long>, reached array<long>")
    ends = run(by_conversation(ways), range_ends, f"{head}, state int, final boolean")
    known = entered.join(ends, key)
    return run(by_range(known, "entered", "state", "final"), block_spans, "conv string, block string, first int, last int, ends boolean")


def repaired(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Rows (conversation, turn, role, new_role, action, inserted, part): one for each turn, in rendered form.

    ``inserted`` names the empty turns put in before a turn and, behind a slash, those after the last one.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    own = F.col(f"`{conv_col}`")
    text, role = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lower(F.trim(F.col(f"`{role_col}`")))
    rows = turns.select(
        F.coalesce(F.concat(F.lit("c"), own.cast("string")), F.concat(F.lit("n"), F.monotonically_increasing_id().cast("string"))).alias("conv"),
        own.alias("own"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), text.alias("text"),
        F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), role) - 1, F.lit(-1)).cast("int").alias("given"),
    )
    rows = rows.withColumn("given", F.when(F.col("given") < 0, START).otherwise(F.col("given")))
    rows = rows.withColumn("tie", F.xxhash64("role", "text")).dropDuplicates(["conv", "turn", "role", "text"])
    # a block is a range of turn numbers; one that holds too many rows is cut again by number and by hash
    wide = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK_TURNS).cast("long")
    rows = stage(rows.withColumn("range", wide), "chat-turns")
    crowded = rows.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 2 * BLOCK_TURNS)
    rows = rows.join(crowded, ["conv", "range"], "left")
    parts = F.ceil(F.col("rows") / BLOCK_TURNS)
    slot = F.floor((F.col("tie") / 2.0**64 + 0.5) * parts).cast("long")
    fine = F.when(F.col("rows").isNull(), F.struct(F.lit(0).cast("long"), F.lit(0).cast("long"))).otherwise(
        F.struct(F.coalesce(F.col("turn"), F.lit(-1)).cast("long"), slot))
    keyed = rows.withColumn("block", F.format_string("%020d.%020d.%020d", F.col("range") + 1, fine["col1"] + 1, fine["col2"]))
    keyed = keyed.select("conv", "block", "own", "turn", "role", "text", "given", "tie")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartition(count, "conv", "block").sortWithinPartitions("conv", "block", F.col("turn").asc_nulls_first(), "tie")

    def costs(batches):
        for (conv, block), held in _groups(batches):
            matrix = block_costs([r[2] for r in held])
            yield pa.record_batch([pa.array([conv]), pa.array([block]), pa.array([matrix.ravel().tolist()], pa.list_(pa.int64()))], ["conv", "block", "costs"])

    matrices = ordered.select("conv", "block", "given").mapInArrow(lambda b: _gathered(costs(b)), "conv string, block string, costs array<long>")
    # staged, as cutting into ranges reads its input twice: for the bounds and for the rows
    spans = _combined(stage(matrices, "chat-costs"), count)
    joined = keyed.join(spans, ["conv", "block"]).repartition(count, "conv", "block")
    joined = joined.sortWithinPartitions("conv", "block", F.col("turn").asc_nulls_first(), "tie")
    kind = {c: id_type(turns, c) for c in (conv_col, turn_col, role_col)}
    names = [conv_col, turn_col, role_col, "new_role", "action", "inserted", "part"]

    def decide(batches):
        types, out = None, []

        def watched():
            nonlocal types
            for batch in batches:
                types = [batch.column(i).type for i in (2, 3, 4)]
                yield batch

        for _, held in _groups(watched()):
            first, last, final = held[0][7:10]
            state = first
            for at, (row, (role, inserted, action)) in enumerate(zip(held, block_choices([r[6] for r in held], first, last), strict=True)):
                closes = final and at == len(held) - 1
                before, after = (",".join(ROLES[r] for r in roles) for roles in (inserted, closing(role)[1] if closes else ()))
                part = rendered_part(state, role, inserted, action, row[5], closes)
                out.append((row[2], row[3], row[4], ROLES[role], action, before + ("/" + after if after else ""), part))
                state = role
            if len(out) >= 2000:
                yield _table_of(out, types)
                out = []
        if out:
            yield _table_of(out, types)

    def _table_of(out, types):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*types, *[pa.string()] * 4], strict=True)], names)

    ddl = f"`{conv_col}` {kind[conv_col]}, `{turn_col}` {kind[turn_col]}, `{role_col}` {kind[role_col]}, new_role string, action string, inserted string, part string"
    return joined.select("conv", "block", "own", "turn", "role", "text", "given", "first", "last", "ends").mapInArrow(decide, ddl)
