"""Structure repair of conversations: the cheapest edits after which their roles read ``(s?(ua)+)?``.

Rows and grammar span a lattice: a node is (rows read, last role written), an arc is an edit with its integer cost. An auction
finds the shortest path: node prices start at a feasible bound, the path's end either raises its price to the best arc and is
given up, or is extended along the best arc. Converged prices make the arcs of shortest paths tight, and the path is traced
along tight arcs, least letter first.

Rows are range-sorted by (conversation, turn, role, text), so a conversation may hold any share of them and cross as many
partitions as it needs. A lattice is solved in chunks of eight rows from its end, each given the prices at the border behind
it. What a conversation that crosses partitions passes on is a 4 x 4 table of costs for each partition: the driver sees two
such rows a partition at most, whatever the size of the table. The digest of one conversation is a hash of its whole text in
order, so ``digest`` reads a conversation that crosses partitions as one sorted stream and holds a letter a row.

Defined results: a null role or text counts as one space; null turns come first; rows of one turn follow each other by role and
text; a null ``conv_id`` is one conversation of its own; repeated rows are duplicates of the first; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import partitions, pinned

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLED, DELETED, INSERTED, TRUNCATED = 3, 4, 3, 3  # costs; a kept row is free
BLANK = " \t\n\x0b\x0c\r"
ENDS = [".", "!", "?"]
#: marks of rows: removed beforehand, blank, duplicate, initial of the role (o: any other), in upper case if truncated
GONE, EMPTY, REPEATED = "-", "b", "d"
#: what has been written last: nothing, system, user, assistant; how each may be followed, and where a reading may end
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ADDED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
NEVER = float("inf")
ACCEPT = (0, NEVER, NEVER, 0)
CHUNK = 8


def _lattice(marks: str, ends: tuple) -> list[list[tuple[str, int, int]]]:
    """Arcs (letter, cost, end) out of each node, letters in ASCII order; the last node is the goal. Only nodes that reach it have arcs."""
    goal = 4 * len(marks) + 4
    arcs = [[] for _ in range(goal + 1)]
    for state, price in enumerate(ends):
        if price != NEVER:
            arcs[4 * len(marks) + state].append(("", price, goal))
    for row in range(len(marks), -1, -1):
        mark = marks[row] if row < len(marks) else None
        for state in range(4):
            node, added = 4 * row + state, ADDED[state]
            if mark is not None:
                arcs[node].append((DELETE, DELETED, node + 4))
                if mark not in (EMPTY, REPEATED):
                    more, kept = (TRUNCATED if mark.isupper() else 0), NEXT[state].get(mark.lower())
                    if kept is not None:
                        arcs[node].append((KEEP, more, 4 * row + 4 + kept))
                    arcs[node].append((REROLE, REROLED + more, 4 * row + 4 + added))
            arcs[node].append((INSERT, INSERTED, 4 * row + added))
    reaches, again = {goal}, True
    while again:
        found = {node for node, out in enumerate(arcs) if any(to in reaches for _, _, to in out)} | {goal}
        again, reaches = found != reaches, found
    return [sorted(arc for arc in out if arc[2] in reaches) for out in arcs]


@lru_cache(maxsize=1 << 16)
def auction(marks: str, ends: tuple) -> tuple:
    """For each of the four states before ``marks``: cost, edits and state after them, given the costs ``ends`` behind them.

    None for a state from which no end can be reached. Prices stay from one state to the next: they are feasible for all.
    """
    arcs = _lattice(marks, ends)
    goal, prices = len(arcs) - 1, [0] * len(arcs)
    found = []
    for origin in range(4):
        if not arcs[origin]:
            found.append(None)
            continue
        path = [origin]
        while path[-1] != goal:
            node = path[-1]
            best, to = min(((cost + prices[to], to) for _, cost, to in arcs[node]), key=lambda x: x[0])
            if prices[node] < best:
                prices[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        node, letters, last = origin, [], origin
        while node != goal:
            letter, last, node = next((letter, node, to) for letter, cost, to in arcs[node] if prices[node] == cost + prices[to])
            letters.append(letter)
        found.append((prices[origin] - prices[goal], "".join(letters), last % 4))
    return tuple(found)


def _before(marks: str, ends: tuple) -> tuple[int, tuple, tuple]:
    """What ``auction`` finds, with the least of ``ends`` taken off, so that equal chunks meet in the cache."""
    base = min(ends)
    found = auction(marks, tuple(x - base for x in ends))
    return base, found, tuple(NEVER if x is None else base + x[0] for x in found)


def _chunks(marks: str) -> list[str]:
    return [marks[i:i + CHUNK] for i in range(0, len(marks), CHUNK)]


def costs(marks: str, ends: tuple) -> tuple:
    """Costs from each state before ``marks``, given those behind it."""
    for chunk in reversed(_chunks(marks)):
        ends = _before(chunk, ends)[2]
    return ends


#: costs behind the last row of a conversation, and the edits that stand there
TAIL = tuple(x[0] for x in auction("", ACCEPT))


def trace(marks: str, ends: tuple, state: int) -> tuple[list[str], int]:
    """The edits of each row, with the insertions before it, and the state after the last row.

    None follow the last row: the costs behind a border are exact, so the arc over it is tight and comes first.
    """
    steps = []
    for chunk in reversed(_chunks(marks)):
        _, found, ends = _before(chunk, ends)
        steps.append(found)
    edits = []
    for found in reversed(steps):
        _, letters, state = found[state]
        edits.append(letters)
    each, held = [], ""
    for letter in "".join(edits):
        held += letter
        if letter != INSERT:
            each.append(held)
            held = ""
    return each, state


@lru_cache(maxsize=1 << 16)
def _whole(marks: str) -> tuple[tuple[str, ...], str]:
    """The edits of a conversation that lies in one partition, and the insertions behind its last row."""
    each, state = trace(marks, TAIL, START)
    return tuple(each), auction("", ACCEPT)[state][1]


def marked(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """``conv_id, turn, role, text, mark, copy``: every row with its first fault; ``gone`` rows only name their conversation."""
    gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    rows = rows.select("conv_id", "turn", F.coalesce(rows["role"].cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(rows["text"].cast("string"), F.lit(" ")).alias("text"), gone.alias("gone"))
    rows = rows.select("conv_id", "gone", *[F.when(~F.col("gone"), F.col(name)).alias(name) for name in ("turn", "role", "text")])
    # equal rows are counted before they travel; which of them is the first makes no difference
    counted = rows.groupBy("conv_id", "turn", "role", "text", "gone").agg(F.count("*").alias("n"))
    counted = counted.withColumn("digest", F.md5("text"))
    at = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = counted.where("not gone").groupBy(F.col("conv_id").alias("of"), F.col("role").alias("as"), F.col("digest").alias("is")).agg(F.min(at).alias("first"))
    met = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("as")) & (F.col("digest") == F.col("is"))
    placed = counted.join(first, met, "left").withColumn("seen", ~at.eqNullSafe(F.col("first")))
    copies = F.when(F.col("gone"), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))
    placed = placed.withColumn("copy", F.explode(copies))
    end, initial = F.rtrim("text", F.lit(BLANK)), F.left("role", F.lit(1))
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    mark = (F.when(F.col("gone"), F.lit(GONE)).when(end == "", F.lit(EMPTY)).when(F.col("seen") | (F.col("copy") > 0), F.lit(REPEATED))
            .when(F.right(end, F.lit(1)).isin(ENDS), kind).otherwise(F.upper(kind)))
    return placed.select("conv_id", "turn", "role", "text", mark.alias("mark"), "copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Range-sorted and pinned, with ``part``: a task that is run again meets the same rows in the same order."""
    count = partitions(rows.sparkSession)
    # long texts that begin alike need no more than their beginning to be dealt; the sort compares them whole
    dealt = rows.repartitionByRange(count, "conv_id", "turn", "role", F.left("text", F.lit(64)), "copy")
    return pinned(dealt.sortWithinPartitions("conv_id", "turn", "role", "text", "copy").withColumn("part", F.spark_partition_id().cast("bigint")))


def _runs(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """(conversation, its rows) one after the other; the rows of a conversation lie together."""
    run, of, part = [], None, None
    for batch in batches:
        for row in zip(*[batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("conv_id", "part", *names)]):
            if run and row[0] != of:
                yield of, part, run
                run = []
            of, part = row[:2]
            run.append(row[2:])
    if run:
        yield of, part, run


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _borders(rows: DataFrame) -> DataFrame:
    """The marks of the first and the last conversation of each partition: only those can cross a border."""

    def outer(batches):
        first = last = None
        for of, part, run in _runs(batches, ["mark"]):
            found = (part, of, "".join(row[0] for row in run).replace(GONE, ""))
            first, last = first or found, found if first else None
        found = [x for x in (first, last) if x]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], ["part", "conv_id", "marks"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [pa.int64(), to_arrow_type(rows.schema["conv_id"].dataType), pa.string()]
    return pinned(rows.select("conv_id", "part", "mark").mapInArrow(outer, f"part bigint, conv_id {_kind(rows, 'conv_id')}, marks string"))


def _crossings(rows: DataFrame) -> dict[tuple, tuple[int, tuple, bool]]:
    """For each (partition, conversation) where a conversation crosses a border: state before, costs behind, whether it ends there.

    Two rows of a partition at most reach the driver, first with a 4 x 4 table of costs, then with four states.
    """
    borders = _borders(rows)

    def tables(batches):
        for batch in batches:
            unit = [tuple(0 if x == y else NEVER for x in range(4)) for y in range(4)]
            found = [[costs(marks, ends) for ends in unit] for marks in batch["marks"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["part"], batch["conv_id"], pa.array([[float(x) for col in table for x in col] for table in found], pa.list_(pa.float64()))], ["part", "conv_id", "costs"])

    kind = _kind(rows, "conv_id")
    whole = borders.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("of"))
    crossing = borders.join(whole, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")
    chains: dict = {}
    for row in crossing.mapInArrow(tables, f"part bigint, conv_id {kind}, costs array<double>").collect():
        chains.setdefault(row["conv_id"], []).append((row["part"], row["costs"]))
    behind = {}
    for of, parts in chains.items():
        ends = TAIL
        for part, table in sorted(parts, reverse=True):
            behind[part, of] = ends
            ends = tuple(min(table[4 * y + x] + ends[y] for y in range(4)) for x in range(4))
    if not behind:
        return {}

    def states(batches):
        for batch in batches:
            keys = list(zip(batch["part"].to_pylist(), batch["conv_id"].to_pylist()))
            after = [[trace(marks, behind[key], x)[1] if costs(marks, behind[key])[x] != NEVER else -1 for x in range(4)]
                     for key, marks in zip(keys, batch["marks"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["part"], batch["conv_id"], pa.array(after, pa.list_(pa.int32()))], ["part", "conv_id", "after"])

    after = {(r["part"], r["conv_id"]): r["after"] for r in crossing.mapInArrow(states, f"part bigint, conv_id {kind}, after array<int>").collect()}
    found = {}
    for of, parts in chains.items():
        state = START
        for part, _ in sorted(parts):
            found[part, of] = (state, behind[part, of], part == max(parts)[0])
            state = after[part, of][state]
    return found


def _schema(rows: DataFrame) -> str:
    return (f"conv_id {_kind(rows, 'conv_id')}, turn {_kind(rows, 'turn')}, place bigint, part bigint, crosses boolean, mark string, "
            "was string, edit string, role string, text string")


def _edited(rows: DataFrame) -> DataFrame:
    """Every row with its edit, and the inserted rows, in order inside each partition."""
    from pyspark.sql.pandas.types import to_arrow_schema

    crossings = _crossings(rows)

    def edit(batches):
        out, place, held = [], 0, 0
        for of, part, run in _runs(batches, ["turn", "mark", "role", "text"]):
            marks = "".join(row[1] for row in run).replace(GONE, "")
            state, ends, over = crossings.get((part, of), (START, TAIL, True))
            crosses = (part, of) in crossings
            if crosses:
                each, after = trace(marks, ends, state)
                tail = auction("", ACCEPT)[after][1] if over else ""
            else:
                each, tail = _whole(marks)
            each = iter(each)
            for turn, mark, role, text in run:
                if mark == GONE:
                    out.append((of, turn, place, part, crosses, mark, role, "", None, None))
                    place += 1
                    continue
                for letter in next(each):
                    if letter == INSERT:
                        state, was, now, said = ADDED[state], None, NAMES[ADDED[state]], ""
                        out.append((of, None, place, part, crosses, None, None, letter, now, said))
                    else:
                        was, now = role, role
                        if letter == REROLE:
                            state = ADDED[state]
                            now = NAMES[state]
                        elif letter == KEEP:
                            state = NEXT[state][role[0]]
                        out.append((of, turn, place, part, crosses, mark, was, letter, now, text))
                        held += len(text)
                    place += 1
            for letter in tail:
                state = ADDED[state]
                out.append((of, None, place, part, crosses, None, None, letter, NAMES[state], ""))
                place += 1
            if len(out) > 4096 or held > 4 << 20:
                yield batch_of(out)
                out, held = [], 0
        yield batch_of(out)

    schema = _schema(rows)
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], field.type) for i, field in enumerate(arrow)], arrow.names)

    return rows.mapInArrow(edit, schema)


def repair(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """The cheapest edits of each conversation in ``rows(conv_id, turn, role, text)``, ties ASCII-least.

    One row for each row and each insertion, ordered inside a conversation by (part, place): ``mark`` (its first fault or its
    role's initial, in upper case if truncated), ``was`` (its role), ``edit`` (K, R, D, I), ``role`` and ``text`` after it.
    Rows of ``gone`` take no part but keep their conversation in the result (``edit`` empty).
    """
    return _edited(_ordered(marked(rows, gone)))


def digest(edits: DataFrame) -> DataFrame:
    """One row a conversation: faults, cost, audit and the hash of the repaired ``role:text`` lines.

    Conversations inside one partition are read where they are; the others are dealt anew, each as one sorted stream.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = (f"conv_id {_kind(edits, 'conv_id')}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
              "cost bigint, audit string, repaired_sha256 string")
    arrow = to_arrow_schema(edits.sparkSession.createDataFrame([], schema).schema)
    names = ["conv_id", "turn", "mark", "was", "edit", "role", "text"]

    def read(batches):
        out, state, of = [], None, None
        for batch in batches:
            for row in zip(*[batch.column(batch.schema.get_field_index(name)).to_pylist() for name in names]):
                if state is None or row[0] != of:
                    if state:
                        out.append((of, *state.result()))
                    state, of = _Digest(), row[0]
                state.add(*row[1:])
            if len(out) > 4096:
                yield batch_of(out)
                out = []
        if state:
            out.append((of, *state.result()))
        yield batch_of(out)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], field.type) for i, field in enumerate(arrow)], arrow.names)

    inside = edits.where("not crosses").mapInArrow(read, schema)
    across = edits.where("crosses").repartition(partitions(edits.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "place")
    return inside.unionByName(across.mapInArrow(read, schema))


class _Digest:
    """Counts over the edits of one conversation in order; holds a hash and a letter a row."""

    def __init__(self) -> None:
        self.turns, self.least, self.most, self.faults = 0, None, None, {"b": 0, "d": 0, "t": 0}
        self.illegal, self.cost, self.initial, self.audit = 0, 0, None, []
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, turn, mark, was, edit, role, text) -> None:
        if not edit:
            return
        if edit != INSERT:
            if turn is not None and turn != self.most:
                self.turns, self.most = self.turns + 1, turn
                self.least = turn if self.least is None else self.least
            fault = "t" if mark.isupper() else mark
            if fault in self.faults:
                self.faults[fault] += 1
            if self.initial is not None and self.initial + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = was[:1]
        self.audit.append(edit)
        late = TRUNCATED if mark is not None and mark.isupper() else 0
        self.cost += {KEEP: late, REROLE: REROLED + late, DELETE: DELETED, INSERT: INSERTED}[edit]
        if edit != DELETE:
            self.hash.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
            self.begun = True

    def result(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return (gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations damaged by ``crc32(conv_id:turn) % 20``, and the column that says which rows are dropped."""
    said = {name: F.coalesce(rows[name].cast("string"), F.lit(" ")) for name in ("conv_id", "turn", "role", "text")}
    key = F.concat(said["conv_id"], F.lit(":"), said["turn"])
    rows = rows.select("conv_id", "turn", said["role"].alias("role"), said["text"].alias("text"), (F.crc32(key.cast("binary")) % 20).alias("code"))
    code = F.col("code")
    text = F.when(code == 1, F.lit("")).when(code == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(code == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "code")
    rows = rows.withColumn("again", F.explode(F.sequence(F.lit(0), F.when(code == 3, 1).otherwise(0))))
    return rows, rows["code"] == 0


def digest_rows(rows: DataFrame) -> DataFrame:
    """What the contract of ``op11`` asks of ``rows``: each conversation damaged, judged and repaired."""
    return digest(repair(*damaged(rows)))
