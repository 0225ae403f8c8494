"""Hard negatives of anchors: a tree of split points with distance ranges between siblings, and exact leaves.

The tree (as in GNAT) is grown from a bounded sample: a node has up to ``FAN`` split points far from each other, a row goes to
the nearest one, so hyperplanes bound the subtrees. Then all rows are dealt to its leaves, and each split point gets the range
of its distances to the rows of every sibling's subtree, from all rows. A search asks for scores in a window: with the norms
in a subtree that is an annulus around the anchor, and a sibling goes if the annulus around some split point cannot meet
that split point's range. Leaves that stay are compared in full, so results are exact.

A leaf is cut into blocks of some ``BLOCK`` rows and its searches into blocks of ``ASKED``; a task compares one with the other
as one matrix product, so a vector that a third of all rows have is no hot group. A first search in the anchor's own leaf gives
the scores that others must reach. The driver holds the sample, the ranges (they follow the tree) and counts by leaf.

Scores are integer inner products of ``floor(256 * x)``. Defined results: rows with a null label, vector or component, or one
that is not finite, take no part; a shorter vector ends in zeros; a null ``vec_id`` is no anchor and comes last among ties;
repeated rows are rows of their own, and each repeated anchor is an anchor; scores that do not fit into 64 bits are given as
the nearest number that does; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import arrow_map, pinned

EVERY, TURNED, LABELS = 100, 7, 10  # anchors, rows whose label moves on, number of labels
POSITIVES, NEGATIVES = 5, 10
#: rows that the tree is grown from, at most; split points of a node; rows that a leaf should hold
SAMPLE, FAN, LEAF = 32_768, 8, 4096
BLOCK, ASKED = 4096, 1024
LEAST, MOST = -(1 << 63), (1 << 63) - 1
EXACT = float(1 << 53)


# --- vectors ---------------------------------------------------------------------------------------------------------------

def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Vectors as rows, filled up with zeros to the longest of them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    width = max(width, int(lengths.max(initial=0)))
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def scaled(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(x * 256)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the scaled rows of ``x`` and ``y``: as 64-bit integers, or Python's where they do not fit."""
    width = max(x.shape[1], y.shape[1])
    x, y = _wide(x, width), _wide(y, width)
    a, b = scaled(x), scaled(y)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, width) < EXACT:
        return (a @ b.T).astype(np.int64)

    def whole(raw, done):
        return np.array([[int(d) if np.isfinite(d) else int(r) * 256 for r, d in zip(*row)] for row in zip(raw, done)], dtype=object).reshape(raw.shape)

    return whole(x, a) @ whole(y, b).T


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], y.shape[1])
    x, y = _wide(x, width), _wide(y, width)
    with np.errstate(all="ignore"):
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0))


# --- the tree --------------------------------------------------------------------------------------------------------------

def grown(sample: np.ndarray, least: int) -> tuple[list[tuple[np.ndarray, list[int]]], int]:
    """Nodes (split points, children) and the number of leaves. A child below 0 is leaf ``-1 - child``; without nodes all is leaf 0."""
    nodes, leaves, pick = [], 0, np.random.default_rng(0)

    def grow(points: np.ndarray) -> int:
        nonlocal leaves
        if len(points) <= max(least, FAN):
            leaves += 1
            return -leaves
        tried = points[np.sort(pick.choice(len(points), min(len(points), 3 * FAN), replace=False))]
        chosen = [0]
        gap = _distances(tried, tried[:1])[:, 0]
        while len(chosen) < FAN and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, _distances(tried, tried[chosen[-1:]])[:, 0])
        splits = tried[chosen]
        nearest = _distances(points, splits).argmin(1)
        at = len(nodes)
        nodes.append((splits, []))
        for child in range(len(splits)):
            nodes[at][1].append(grow(points[nearest == child]))
        return at

    points = np.unique(sample, axis=0) if len(sample) else sample
    points = points[np.isfinite(_distances(points, points[:1])).all(1)] if len(points) else points
    grow(points)
    return nodes, leaves


def _descend(nodes: list, x: np.ndarray, see) -> np.ndarray:
    """The leaf of each row; ``see(node, rows, distances, child of each)`` at every node on the way."""
    leaf = np.zeros(len(x), dtype=np.int32)
    todo = [(0, np.arange(len(x)))] if nodes else []
    while todo:
        at, rows = todo.pop()
        far = _distances(x[rows], nodes[at][0])
        nearest = np.nan_to_num(far, nan=np.inf, posinf=np.inf).argmin(1)
        see(at, rows, far, nearest)
        for child, to in enumerate(nodes[at][1]):
            own = rows[nearest == child]
            if not len(own):
                continue
            if to < 0:
                leaf[own] = -1 - to
            else:
                todo.append((to, own))
    return leaf


class Tree:
    """Split points, and for each node the ranges between them and the subtrees, as all rows gave them."""

    def __init__(self, nodes: list, leaves: int, found: list) -> None:
        self.nodes, self.leaves, self.ranges = nodes, leaves, {}
        for at, (splits, _) in enumerate(nodes):
            m = len(splits)
            self.ranges[at] = (np.full((m, m), np.inf), np.full((m, m), -np.inf), np.full(m, np.inf), np.full(m, -np.inf))
        for at, split, child, low, high in found:
            low_all, high_all, least, most = self.ranges[at]
            if split < 0:
                least[child], most[child] = low, high
            else:
                low_all[split, child], high_all[split, child] = low, high

    def leaves_of(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, searches, windows) that can hold a score from ``low`` to ``high``; both have a row a search, a column a window."""
        if not self.nodes:
            return [(0, np.arange(len(x)), low <= high)]
        out, norm = [], np.sqrt((x * x).sum(1))
        todo = [(0, np.arange(len(x)), low <= high)]
        while todo:
            at, rows, alive = todo.pop()
            splits, children = self.nodes[at]
            near, far, least, most = self.ranges[at]
            gap, own, slack = _distances(x[rows], splits), norm[rows], 0
            with np.errstate(all="ignore"):
                slack = 1e-6 * (1 + own[:, None] + np.sqrt((splits * splits).sum(1)).max())
                for child, to in enumerate(children):
                    if most[child] < 0:  # no row is there
                        continue
                    outer = (own ** 2 + most[child] ** 2)[:, None] - 2 * low[rows].astype(float)
                    inner = (own ** 2 + least[child] ** 2)[:, None] - 2 * high[rows].astype(float)
                    outer_at, inner_at = np.sqrt(np.maximum(outer, 0)), np.sqrt(np.maximum(inner, 0))
                    loose = (slack + 1e-6 * most[child])[:, :, None]
                    d, o, i = gap[:, None, :], outer_at[:, :, None], inner_at[:, :, None]
                    lost = (np.maximum(d - o, i - d) > far[:, child] + loose) | (d + o < near[:, child] - loose)
                    stay = alive & ~lost.any(2) & ~(outer < -loose[:, :, 0] * (1 + own[:, None] + most[child]))
                    kept = stay.any(1)
                    if not kept.any():
                        continue
                    if to < 0:
                        out.append((-1 - to, rows[kept], stay[kept]))
                    else:
                        todo.append((to, rows[kept], stay[kept]))
        return out


# --- Spark -----------------------------------------------------------------------------------------------------------------

def prepared(rows: DataFrame) -> DataFrame:
    """``node, vec_id, label, x`` of the rows that take part, numbered once."""
    kept_as = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    x = rows["embedding"].cast(kept_as)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    kept = rows.where(rows["label"].isNotNull() & rows["embedding"].isNotNull() & ~odd)
    vec_id, label = rows["vec_id"].cast("bigint"), rows["label"].cast("bigint")
    label = F.when(vec_id % TURNED == 0, (label + 1) % LABELS).otherwise(label)
    return pinned(kept.select(F.monotonically_increasing_id().alias("node"), vec_id.alias("vec_id"), label.alias("label"), x.alias("x")))


def indexed(rows: DataFrame) -> tuple[Tree, DataFrame, list[int]]:
    """The tree, ``rows`` with their ``leaf``, and the number of rows of each leaf."""
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("node")).limit(SAMPLE).select("x").toArrow()["x"]
    drawn = scaled(_matrix(sample))
    nodes, leaves = grown(drawn, LEAF * len(drawn) // max(1, total))

    def deal(batch):
        leaf = _descend(nodes, scaled(_matrix(batch["x"])), lambda *_: None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    data = pinned(arrow_map(rows, deal, f"node bigint, vec_id bigint, label bigint, x {_kind(rows)}, leaf int"))

    def measure(batch):
        x, found = scaled(_matrix(batch["x"])), []

        def see(at, own, far, nearest):
            norm = np.sqrt((x[own] ** 2).sum(1))
            for child in np.unique(nearest):
                mine = far[nearest == child]
                found.append((at, -1, child, norm[nearest == child].min(), norm[nearest == child].max()))
                found.extend((at, split, child, mine[:, split].min(), mine[:, split].max()) for split in range(far.shape[1]))

        with np.errstate(all="ignore"):
            _descend(nodes, x, see)
        yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in found], kind) for i, kind in enumerate(
            (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))], ["at", "split", "child", "low", "high"])

    ranges = arrow_map(data, measure, "at int, split int, child int, low double, high double")
    ranges = ranges.groupBy("at", "split", "child").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    tree = Tree(nodes, leaves, [tuple(row) for row in ranges.collect()])
    sizes = [0] * leaves
    for row in data.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        sizes[row["leaf"]] = row["n"]
    return tree, data, sizes


def _kind(rows: DataFrame) -> str:
    return rows.schema["x"].dataType.simpleString()


def routed(tree: Tree, searches: DataFrame) -> DataFrame:
    """Each search once for every leaf, apart from its own, that can hold what it looks for; other windows are empty there."""

    def route(batch):
        low, high = (np.array(batch[name].to_pylist(), dtype=np.int64).reshape(batch.num_rows, -1) for name in ("low", "high"))
        home = batch["leaf"].to_numpy()
        for leaf, rows, alive in tree.leaves_of(scaled(_matrix(batch["x"])), low, high):
            other = home[rows] != leaf
            rows, alive = rows[other], alive[other]
            if not len(rows):
                continue
            own = batch.take(pa.array(rows))
            lows, highs = np.where(alive, low[rows], 1), np.where(alive, high[rows], 0)
            yield pa.RecordBatch.from_arrays([own["node"], own["label"], own["x"], pa.array(list(lows), pa.list_(pa.int64())),
                                              pa.array(list(highs), pa.list_(pa.int64())), pa.array(np.full(len(rows), leaf, np.int32))],
                                             ["node", "label", "x", "low", "high", "leaf"])

    return arrow_map(searches.select("node", "label", "x", "low", "high", "leaf"), route,
                     f"node bigint, label bigint, x {_kind(searches)}, low array<bigint>, high array<bigint>, leaf int", most_bytes=1 << 20)


def _blocks(counts: list[int], size: int) -> Column:
    return F.element_at(F.array(*[F.lit(max(1, -(-n // size))) for n in counts]), F.col("leaf") + 1)


def scanned(searches: DataFrame, data: DataFrame, sizes: list[int], same: bool, most: int) -> DataFrame:
    """``node, at, vec_id, other, score``: of each search's windows (``at``) the first rows in its leaf, with the same or an other label."""
    asked = [0] * len(sizes)
    for row in searches.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        asked[row["leaf"]] = row["n"]
    cut, split = _blocks(sizes, BLOCK), _blocks(asked, ASKED)
    rows = data.select("leaf", F.pmod(F.xxhash64("node"), cut).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), split - 1)).alias("part"), "node", "vec_id", "label", "x")
    asks = searches.select("leaf", F.explode(F.sequence(F.lit(0), cut - 1)).alias("block"),
                           F.pmod(F.xxhash64("node"), split).cast("int").alias("part"), "node", "label", "x", "low", "high")
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["node", "at", "vec_id", "other", "score"]

    def compare(_, asks: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[] for _ in names]
        if asks.num_rows and rows.num_rows:
            label, node = rows["label"].to_numpy(), rows["node"].to_numpy()
            ids = np.array([np.inf if v is None else 0 for v in rows["vec_id"].to_pylist()])
            known = rows["vec_id"].fill_null(0).to_numpy()
            by_id = np.lexsort((node, known, ids))  # nulls last
            rows, label, node = rows.take(pa.array(by_id)), label[by_id], node[by_id]
            score = products(_matrix(rows["x"]), _matrix(asks["x"]))
            vec_id = rows["vec_id"].to_pylist()
            for col, (own, kind, lows, highs) in enumerate(zip(*[asks[name].to_pylist() for name in ("node", "label", "low", "high")])):
                fits = np.flatnonzero((label == kind) & (node != own) if same else label != kind)
                mine = score[fits, col]
                order = np.argsort(-mine, kind="stable")
                ranked = -mine[order]
                for at, (low, high) in enumerate(zip(lows, highs)):
                    if low > high:
                        continue
                    first = np.searchsorted(ranked, -high, "left") if high < MOST else 0
                    last = np.searchsorted(ranked, -low, "right") if low > LEAST else len(ranked)
                    for place in order[first:min(last, first + most)]:
                        row = fits[place]
                        for list_, value in zip(out, (own, at, vec_id[row], int(node[row]), min(max(int(mine[place]), LEAST), MOST))):
                            list_.append(value)
        return pa.table([pa.array(x, kind) for x, kind in zip(out, kinds)], names=names)

    keys = ["leaf", "block", "part"]
    return asks.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(compare, "node bigint, at int, vec_id bigint, other bigint, score bigint")


def first_of(found: DataFrame, most: int) -> DataFrame:
    """The first rows of each window over all leaves, with their ``rank`` from 1."""
    order = Window.partitionBy("node", "at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def searched(tree: Tree, data: DataFrame, sizes: list[int], searches: DataFrame, same: bool, most: int) -> DataFrame:
    """The first ``most`` rows of every window: those of the anchor's own leaf first, which say what the others must reach."""
    near = pinned(first_of(scanned(searches, data, sizes, same, most), most).drop("rank"))
    reached = near.groupBy("node", "at").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == most)
    reached = reached.groupBy(F.col("node").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("at", "least"))).alias("reached"))
    raised = F.transform("low", lambda v, i: F.greatest(v, F.coalesce(F.try_element_at("reached", i), v)))
    further = searches.join(reached, searches["node"] == F.col("of"), "left").withColumn("low", raised)
    far = pinned(routed(tree, further))
    return first_of(near.unionByName(scanned(far, data, sizes, same, most)), most)


def hard_negatives(rows: DataFrame) -> DataFrame:
    """Hard negatives of each anchor and positive in ``rows(vec_id, label, embedding)``, as the contract of ``op13`` states them."""
    tree, data, sizes = indexed(prepared(rows))
    anchors = data.where(F.col("vec_id") % EVERY == 0)
    all_scores = anchors.withColumns({"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(MOST))})
    positives = pinned(searched(tree, data, sizes, all_scores, True, POSITIVES).select("node", "rank", "vec_id", "score"))
    # of a window from 30 to 90 hundredths; a score below 0 has none
    p = F.col("score")
    tens, rest = F.expr("score div 100"), p % 100
    low = F.when(p < 0, 1).otherwise(tens * 30 + F.floor((rest * 30 + 99) / 100)).cast("bigint")
    high = F.when(p < 0, 0).otherwise(tens * 90 + F.floor(rest * 90 / 100)).cast("bigint")
    each = F.array_sort(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high"))))
    windows = positives.groupBy(F.col("node").alias("of")).agg(each.alias("windows"))
    asks = anchors.join(windows, anchors["node"] == F.col("of")).select(*data.columns, F.col("windows.low").alias("low"), F.col("windows.high").alias("high"))
    none = F.lit(0).cast("bigint")
    short = F.lit(POSITIVES) - F.size("low")  # as many windows for every anchor; those without a positive are empty
    asks = pinned(asks.withColumns({"low": F.concat("low", F.array_repeat(none + 1, short)), "high": F.concat("high", F.array_repeat(none, short))}))
    negatives = searched(tree, data, sizes, asks, False, NEGATIVES)
    named = positives.select(F.col("node").alias("of"), (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    who = anchors.select(F.col("node").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    joined = negatives.join(named, (negatives["node"] == F.col("of")) & (negatives["at"] == F.col("window"))).join(who, negatives["node"] == F.col("anchor"))
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
