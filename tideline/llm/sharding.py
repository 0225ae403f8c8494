"""Shards of equal row counts that keep linked documents together: balanced label propagation in Spark joins.

Links come as memberships (node, hub): nodes that share a hub are linked, so a hub of n nodes costs n rows and not n * n. In
each round the hubs count their nodes by shard (partial sums, so a hub with a third of all rows is no hot key), each node adds
up what its hubs saw and asks for the shard where most of its neighbours are. Of those who ask for a shard as many are let in
as its quota has room for. A shard that turns most away is closed: groups that would fit into another gather there instead, and
only those too large for any shard still take what room it has. A table of shards by shards is all that reaches the driver.
Nodes without links go wherever there is room.

At the end all rows are put in one order - by shard, unlinked rows at both of its ends, members of a hub side by side - and cut
at the exact quotas. What random admission has left uneven then moves unlinked rows first, and at most one hub is cut at each
border.

Defined results: a null text counts as empty; equal rows are rows of their own; a null ``doc_id`` is placed like any other;
fewer rows than shards leave the last shards empty; no rows give no rows. Shards depend on the order of the input's files only
for rows without a ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import pinned, text_bytes
from tideline.operators.ordering import dense_position

SHARDS = 8
#: rounds of moves at most; a group that fits into a shard meets in the first, later ones fill shards with parts of larger groups
ROUNDS = 12
#: a shard that admits less than this share of those who ask is closed; groups too large for a shard use it up to ``FULL``
CLOSED, FULL = 0.5, 0.95
#: quotas are wider by this share while nodes move, so that those who swap need not be equally many; the last cut is exact
SLACK = 0.1


def _share(*columns: Column) -> Column:
    """A number from 0 to 1 that depends on ``columns`` only."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard: at most one apart."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def admitted(asked: dict[tuple[int, int], int], held: list[int], most: list[float]) -> list[float]:
    """The share of those who ask for each shard that gets in, so that none holds more than its quota."""
    shares = [1.0] * len(most)
    wanted = [sum(n for (_, to), n in asked.items() if to == j) for j in range(len(most))]
    for _ in range(8 * len(most)):
        leaving = [sum(n * shares[to] for (own, to), n in asked.items() if own == j) for j in range(len(most))]
        found = [min(shares[j], max(0.0, most[j] - held[j] + leaving[j]) / wanted[j]) if wanted[j] else 1.0 for j in range(len(most))]
        if found == shares:
            break
        shares = found
    return shares


def propagated(links: DataFrame, rows: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``node, shard, hub`` for every node of ``links(node, start, hub)`` that shares a hub with another.

    ``start`` (from 0 to 1) places it at first, ``hub`` is its least one, ``rows`` counts the nodes with and without links.
    """
    links = pinned(links.select("node", "start", "hub").distinct())
    size = links.groupBy(F.col("hub").alias("of")).agg(F.count("*").alias("n")).where("n > 1")
    # counts are written out, so that both sides of a join are dealt anew and a hub with very many nodes can be split
    links = pinned(links.join(pinned(size), F.col("hub") == F.col("of")).select("node", "start", "hub"))
    state = links.groupBy("node").agg(F.least(F.floor(F.min("start") * shards), F.lit(shards - 1)).cast("int").alias("shard"))
    members, most, closed, full = links.select("node", "hub"), [quota * (1 + SLACK) for quota in quotas(rows, shards)], set(), set()
    for turn in range(rounds):
        placed = members.join(state, "node")
        hubs = placed.groupBy(F.col("hub").alias("of")).agg(*[F.count_if(F.col("shard") == s).alias(f"n{s}") for s in range(shards)])
        seen = placed.join(pinned(hubs), F.col("hub") == F.col("of")).groupBy("node").agg(
            F.first("shard").alias("shard"), F.xxhash64(F.min("hub")).alias("turned"), *[F.sum(f"n{s}").alias(f"n{s}") for s in range(shards)])
        total = sum([F.col(f"n{s}") for s in range(1, shards)], F.col("n0"))
        large = total > rows // shards

        def votes(s: int) -> Column:
            """Neighbours in shard ``s``, or -1 if the node shall not be there."""
            own, n = F.col("shard") == s, F.col(f"n{s}")
            whole = own & ((n == total) | large)
            shut = (~large if s in closed else F.lit(False)) | (large if s in full else F.lit(False))
            return F.when(whole | ~shut, n).otherwise(F.lit(-1))

        best = F.array_max(F.array(*[F.struct(votes(s).alias("n"), F.pmod(F.col("turned") + s, F.lit(shards)).alias("first"),
                                           F.lit(s).alias("s")) for s in range(shards)]))
        # among shards with as many neighbours the hub decides: all its members agree, and as many ask for each shard
        asks = pinned(seen.select("node", "shard", (F.when(best["n"] < 0, F.col("shard")).otherwise(best["s"])).alias("to")))
        found = {(r["shard"], r["to"]): r["n"] for r in asks.groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}
        held = [sum(n for (own, _), n in found.items() if own == j) for j in range(shards)]
        asked = {key: n for key, n in found.items() if key[0] != key[1]}
        shares = admitted(asked, held, most)
        let_in = F.element_at(F.array(*[F.lit(x) for x in shares]), F.col("to") + 1)
        state = asks.select("node", F.when(_share(F.col("node"), F.lit(turn)) < let_in, F.col("to")).otherwise(F.col("shard")).alias("shard"))
        if not any(n * shares[to] >= 1 for (_, to), n in asked.items()):
            break
        closed |= {j for j in range(shards) if shares[j] < CLOSED}
        left = [held[j] + sum(n * shares[to] * ((to == j) - (own == j)) for (own, to), n in asked.items()) for j in range(shards)]
        full = {j for j in range(shards) if left[j] >= FULL * most[j]}
    return members.groupBy("node").agg(F.min("hub").alias("hub")).join(state, "node")


def sharded(nodes: DataFrame, links: DataFrame, order: list[str], shards: int = SHARDS) -> DataFrame:
    """``nodes(node, start, ...)`` with ``shard`` and ``slot``: counts at most one apart, nodes that share a hub together.

    ``order`` names columns that say in which order rows of one hub, and rows without links, are numbered.
    """
    rows = nodes.count()
    placed = propagated(links, rows, shards).select(F.col("node").alias("of"), F.col("shard").alias("to"), "hub")
    held = {r["to"]: r["n"] for r in placed.groupBy("to").agg(F.count("*").alias("n")).collect()}
    room = [max(0, quota - held.get(j, 0)) for j, quota in enumerate(quotas(rows, shards))]
    upto = [sum(room[:j + 1]) / max(1, sum(room)) for j in range(shards)]
    start = F.col("start")
    free = sum([(start >= x).cast("int") for x in upto[:-1]], F.lit(0))
    every = nodes.join(placed, nodes["node"] == F.col("of"), "left")
    linked = F.col("to").isNotNull()
    # unlinked rows stand on both sides of the linked ones, so that a border that shifts takes those
    side = F.when(linked, F.lit(1)).when(_share(F.col("node"), F.lit(-1)) < 0.5, F.lit(0)).otherwise(F.lit(2))
    every = every.select(*nodes.columns, F.coalesce("to", free).alias("at"), side.alias("side"), "hub")
    numbered = dense_position(every, ["at", "side", "hub", *order, "node"], "position")
    few, extra = divmod(rows, shards)
    place, cut = F.col("position") - 1, extra * (few + 1)
    late = place - cut
    shard = F.when(place < cut, F.floor(place / (few + 1))).otherwise(extra + F.floor(late / max(1, few)))
    slot = F.when(place < cut, place % (few + 1)).otherwise(late % max(1, few))
    return numbered.select(*nodes.columns, shard.cast("int").alias("shard"), slot.cast("bigint").alias("slot"))


def documents(docs: DataFrame) -> DataFrame:
    """``node, start, doc_id, size, text_crc32, hub`` of each row; equal texts share a hub. Numbered once, for good."""
    text = text_bytes(docs["text"])
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("hub"))
    rows = pinned(rows.withColumn("node", F.monotonically_increasing_id()))
    return rows.withColumn("start", _share(F.coalesce(F.col("doc_id"), F.col("node"))))


def digest_rows(docs: DataFrame) -> DataFrame:
    """What the contract of ``op12`` asks of ``docs``, by the law ``rows``."""
    rows = documents(docs)
    found = sharded(rows.drop("hub"), rows.select("node", "start", "hub"), ["doc_id"])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
