"""A trie of conversation prefixes, and sums over its subtrees by centroid decomposition.

A node is a distinct sequence of first turns; it is named by its smallest conversation and its depth. Sequences are told
apart by 128 bits: the exclusive or, over the turns, of two hashes of a turn's place and its MD5. So a prefix's key is a
running sum that can be carried over pieces of a long conversation, and no text is joined.

``rollup`` splits the forest of parent edges at centroids. Every node begins with the weight of its subtree, each node
counting as often as conversations hold it: that is a plain sum over the turns. In a component of weight W the nodes of
more than W / 2 form a path from its top; the last of them is the centroid, since none of its children has more. Its
subtree's sums are those of its component's nodes below it; they are added to the nodes of the path, which lose its
weight. What hangs on the centroid and what is left around the path are components of at most W / 2. So the rounds grow
with the logarithm of the weight, not with the depth. Components of weight ``small`` or less, hence of at most as many
nodes, are split the same way within a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import cleared, stored

PIECE = 4096  # turns of a conversation whose keys one task sums
KEY = ["depth", "k1", "k2"]


def digest_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, hi, lo, n_bytes) of conversations (conv_id, turn, role, text): place is the number, from 1, in the order of turn.

    A null turn comes first; of turns of one number role, then text decide, and equal rows are turns of their own. A null
    role or text is empty, and rows without a conv_id are in no conversation. hi and lo are the MD5 of role and text.
    Rows are cut into ranges of (conv_id, turn), so that a conversation of very many turns is sorted by many tasks.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    md5 = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    halves = [F.conv(F.substring(md5, k, 16), 16, -10).cast("long").alias(c) for k, c in ((1, "hi"), (17, "lo"))]
    # stored, as ranges are drawn anew each time; the number's upper bits are the range
    cut = stored(rows.select("conv_id", F.monotonically_increasing_id().alias("at"), *halves, F.octet_length("text").cast("long").alias("n_bytes")))
    cut = cut.withColumn("part", F.shiftright("at", 33))
    spans = cut.groupBy("conv_id", "part").agg(F.min("at").alias("lo_at"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("conv_id", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("lo_at") + 1).alias("shift"))
    return cut.join(spans, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("place"), "hi", "lo", "n_bytes")


def graft(turns: DataFrame, convs: DataFrame, stock: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns and (conv_id, n_turns) of conversations whose first turns come from another one.

    Of convs (conv_id, n_turns), each gets the first ``heads`` (at most ``most``) turns of the conversation ``stock``, or
    as many as it has, and then its own turns after its first ``heads``.
    """
    theirs = convs.select(F.col("conv_id").alias("stock"), F.col("n_turns").alias("have"))
    plan = convs.select("conv_id", "n_turns", stock.alias("stock"), heads.cast("long").alias("h")).join(theirs, "stock", "left")
    plan = plan.withColumn("take", F.least("h", F.coalesce("have", F.lit(0))))
    digest = ["hi", "lo", "n_bytes"]
    own = turns.join(plan.select("conv_id", "h", "take"), "conv_id").where("place > h").select("conv_id", (F.col("take") + F.col("place") - F.col("h")).alias("place"), *digest)
    source = turns.where(F.col("place") <= most).withColumnRenamed("conv_id", "stock")
    new = source.join(plan.select("conv_id", "stock", "take"), "stock").where("place <= take").select("conv_id", "place", *digest)
    left = F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))
    return own.unionAll(new), plan.select("conv_id", (F.col("take") + left).alias("n_turns"))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, n_bytes, n_turns): a row for each prefix of each conversation, the empty one with it.

    k1, k2 tell the prefix among those of its depth, p1, p2 the one without its last turn.
    """
    tag = [F.xxhash64("place", "hi", "lo").alias("t1"), F.xxhash64(F.lit(1), "lo", "hi", "place").alias("t2")]
    rows = turns.select("conv_id", "place", F.expr(f"(place - 1) div {PIECE}").alias("piece"), *tag, "n_bytes")
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("conv_id", "piece").agg(F.bit_xor("t1").alias("c1"), F.bit_xor("t2").alias("c2"))
    carry = carry.select("conv_id", "piece", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("c1", "c2")))
    inside = Window.partitionBy("conv_id", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(carry, ["conv_id", "piece"]).join(convs, "conv_id")
    keys = [F.bit_xor(F.col(f"t{k}")).over(inside).bitwiseXOR(F.col(f"c{k}")).alias(f"k{k}") for k in (1, 2)]
    rows = rows.select("conv_id", F.col("place").alias("depth"), *keys, "t1", "t2", "n_bytes", "n_turns")
    back = [F.col(f"k{k}").bitwiseXOR(F.col(f"t{k}")).alias(f"p{k}") for k in (1, 2)]
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    tops = convs.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("n_bytes"), "n_turns")
    return rows.select("conv_id", "depth", "k1", "k2", *back, "n_bytes", "n_turns").unionAll(tops)


def ends_digest(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of rows (depth, k1, k2, conv_id): SHA-256 of the ids of each node, ascending, joined by commas.

    The hash takes ids one after the other, so a node's ids pass through one task; they are sorted by Spark, which
    spills, and the task holds none of them.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids, out = np.stack([c.to_numpy() for c in batch.columns[:3]], axis=1), batch.column(3).to_pylist(), []
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                text = ",".join(map(str, ids[a:b])).encode()
                if (key := tuple(keys[a].tolist())) == node:
                    state.update(b"," + text)
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(text)
            yield pa.RecordBatch.from_pylist([dict(zip([*KEY, "ends_sha256"], r, strict=True)) for r in out], schema)
        if node:
            yield pa.RecordBatch.from_pylist([dict(zip([*KEY, "ends_sha256"], (*node, state.hexdigest()), strict=True))], schema)

    schema = pa.schema([*((c, pa.int64()) for c in KEY), ("ends_sha256", pa.string())])
    rows = rows.select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    return rows.mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def split_component(parent: list[int], weight: list[int], own: list[list[int]]) -> list[list[int]]:
    """For each list of values by node, the sums over the nodes below each node, by centroid decomposition.

    The nodes are one component: parent is by index, -1 for the top, which is first; weight is that of each subtree.
    """
    n = len(parent)
    kids: list[list[int]] = [[] for _ in range(n)]
    for v in range(1, n):
        kids[parent[v]].append(v)
    order, size, todo = [], [1] * n, [0]
    while todo:
        order.append(v := todo.pop())
        todo += kids[v]
    for v in reversed(order[1:]):
        size[parent[v]] += size[v]
    at = [0] * n  # place in preorder: a subtree is a run of places
    for k, v in enumerate(order):
        at[v] = k
    below, weight, components = [[0] * n for _ in own], weight[:], [order]
    while components:
        nodes = components.pop()
        path = [v for v in nodes if 2 * weight[v] > weight[nodes[0]]]
        c = path.pop()
        under = [v for v in nodes if at[c] < at[v] < at[c] + size[c]]
        for mine, sums in zip(own, below, strict=True):
            held = sum(mine[v] for v in under)
            sums[c] += held
            for v in path:
                sums[v] += held + mine[c]
        for v in path:
            weight[v] -= weight[c]
        if path:
            components.append([v for v in nodes if not at[c] <= at[v] < at[c] + size[c]])
        starts = [k for k, v in enumerate(under) if parent[v] == c]
        components += [under[i:j] for i, j in zip(starts, [*starts[1:], len(under)], strict=False)]
    return below


NODE, TOP = ["conv_id", "depth"], ["top_conv", "top_depth"]


def _split_in_tasks(parts: DataFrame, sums: list[str]) -> DataFrame:
    """Rows of small components with the sums below each node added; each component lies in one task, some at a time."""
    names = [*NODE, "parent_conv_id", *TOP, "weight", *sums, *(f"below_{c}" for c in sums)]
    kinds = ", ".join(f"{c} long" for c in [*NODE, *(f"below_{c}" for c in sums)])

    def solve(rows: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
        """rows of one component, by depth."""
        index = {r[:2]: k for k, r in enumerate(rows)}
        parent = [-1, *(index[r[2], r[1] - 1] for r in rows[1:])]
        below = split_component(parent, [r[5] for r in rows], [[r[6 + k] for r in rows] for k in range(len(sums))])
        return [(*r[:2], *(r[6 + len(sums) + k] + b[i] for k, b in enumerate(below))) for i, r in enumerate(rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[int, ...]] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kept and kept[-1][3:5] != row[3:5]:
                    out += solve(kept)
                    kept = []
                kept.append(row)
            yield made(out)
        yield made(solve(kept) if kept else [])

    def made(rows: list[tuple[int, ...]]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * (2 + len(sums))
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], [*NODE, *(f"below_{c}" for c in sums)])

    return parts.select(names).repartition(*TOP).sortWithinPartitions(*TOP, "depth").mapInArrow(run, kinds)


def rollup(nodes: DataFrame, paths: DataFrame, sums: list[str], *, small: int = 1 << 14) -> DataFrame:
    """(conv_id, depth, below_...): for each node the sums of columns over the nodes below it.

    nodes (conv_id, depth, parent_conv_id, weight, sums ...) is stored, and its weights are those of whole subtrees,
    more than their children's together. paths (conv_id, depth, node, parent) gives for conversations that name nodes
    the node at each depth and the one before. See the module for the rounds; the centroids of a round are at most
    the whole weight by small.
    """
    top = nodes.orderBy("depth").select("conv_id", "depth", "weight").first()
    if top is None:
        return nodes.select(*NODE, *(F.lit(0).cast("long").alias(f"below_{c}") for c in sums))
    below = [f"below_{c}" for c in sums]
    first = [F.lit(v).cast("long").alias(c) for v, c in zip((*top, *[0] * len(sums)), (*TOP, "whole", *below), strict=True)]
    open_ = nodes.select(*NODE, "parent_conv_id", "weight", *sums, *first)
    done, largest, old = [], top[2], None
    while largest > small:
        big = open_.where(F.col("whole") > small)
        on_path = 2 * F.col("weight") > F.col("whole")
        done.append(_split_in_tasks(open_.where(F.col("whole") <= small), sums))
        best = F.min_by(F.struct(F.col("conv_id").alias("c_conv"), F.col("depth").alias("c_depth"), F.col("weight").alias("c_weight")), "weight")
        cut = stored(big.where(on_path).groupBy(*TOP).agg(best.alias("c")).select(*TOP, "c.*"))
        assert cut.count() <= top[2] // small  # as each holds more than small
        rows = big.join(F.broadcast(cut), TOP)
        way = paths.select(F.col("conv_id"), F.col("depth").alias("step"), "node", "parent")
        rows = rows.withColumn("step", F.col("c_depth") + 1)
        under = rows.where("depth > c_depth").join(way, ["conv_id", "step"]).withColumn("node", F.when(F.col("parent") == F.col("c_conv"), F.col("node"))).drop("parent")
        rows = under.unionByName(rows.where("depth <= c_depth").withColumn("node", F.lit(None).cast("long")))
        rows = stored(rows.withColumn("is_c", (F.col("conv_id") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))))
        hung = rows.where("node is not null").groupBy(*TOP, "node").agg(F.max("weight").alias("new_whole"), *(F.sum(c).alias(f"held_{c}") for c in sums))
        hung = stored(hung)
        total = hung.groupBy(*TOP).agg(*(F.sum(f"held_{c}").alias(f"held_{c}") for c in sums))
        centre = rows.where("is_c").select(*NODE, *TOP, *sums, *below).join(F.broadcast(total), TOP, "left")
        got = [F.coalesce(f"held_{c}", F.lit(0)).alias(f"held_{c}") for c in sums]
        centre = stored(centre.select(*NODE, *TOP, *sums, *below, *got))
        done.append(centre.select(*NODE, *((F.col(b) + F.col(f"held_{c}")).alias(b) for b, c in zip(below, sums, strict=True))))
        gain = centre.select(*TOP, *((F.col(c) + F.col(f"held_{c}")).alias(f"gain_{c}") for c in sums))
        keep = [*NODE, "parent_conv_id", "weight", *sums, *TOP, "whole", *below]
        down = rows.where("node is not null").join(hung.select(*TOP, "node", "new_whole"), [*TOP, "node"])
        down = down.select(*NODE, "parent_conv_id", "weight", *sums, F.col("node").alias("top_conv"), F.col("step").alias("top_depth"), F.col("new_whole").alias("whole"), *below)
        up = rows.where("node is null and not is_c").join(F.broadcast(gain), TOP)
        more = [F.when(on_path, F.col(b) + F.col(f"gain_{c}")).otherwise(F.col(b)).alias(b) for b, c in zip(below, sums, strict=True)]
        lighter = F.when(on_path, F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")).alias("weight")
        up = up.select(*NODE, "parent_conv_id", lighter, *sums, *TOP, (F.col("whole") - F.col("c_weight")).alias("whole"), *more)
        open_ = stored(up.select(keep).unionAll(down.select(keep)))
        cleared(rows, hung)
        largest = open_.agg(F.max("whole")).first()[0] or 0
    done.append(_split_in_tasks(open_, sums))
    out = done[0]
    for more_done in done[1:]:
        out = out.unionByName(more_done)
    return out


def prefix_trie(turns: DataFrame, convs: DataFrame, *, small: int = 1 << 14) -> DataFrame:
    """The nodes of the trie of conversations convs (conv_id, n_turns) with turns (conv_id, place, hi, lo, n_bytes).

    Gives (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): n_convs begin with
    the node's sequence, n_leaves nodes without children are in its subtree; saved_tokens are the bytes of last texts in it
    that more than one conversation repeats. Nodes of
    one depth whose sequences agree in 128 bits are one. No conversation gives no node, not even a root.
    """
    rows = stored(prefixes(turns, convs))
    size = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("n_turns") - F.col("depth") + 1).alias("weight")]
    nodes = stored(rows.groupBy(*KEY).agg(*size, F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("n_bytes").alias("n_bytes")))
    root = nodes.where("depth = 0").select("conv_id").first()
    mother = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")).where("depth > 1")
    # the root's children, which may be most nodes, need no join
    top = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root[0] if root else None).cast("long")))
    nodes = top.unionByName(nodes.where("depth > 1").join(mother, ["depth", "p1", "p2"]))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.join(ends_digest(rows.where("depth = n_turns")), KEY, "left")
    nodes = nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes"))
    nodes = stored(nodes.select(*NODE, "parent_conv_id", "k1", "k2", "n_convs", "n_children", "weight", "ends_sha256", "leaf", "saved"))
    paths = rows.where("depth > 0").select(F.col("conv_id").alias("of"), *KEY).join(nodes.select(*KEY, "conv_id", "parent_conv_id"), KEY)
    paths = paths.select(F.col("of").alias("conv_id"), "depth", F.col("conv_id").alias("node"), F.col("parent_conv_id").alias("parent"))
    if root and nodes.where("depth = 0 and weight > " + str(small)).first():
        paths = stored(paths)
    found = rollup(nodes, paths, ["leaf", "saved"], small=small)
    out = nodes.join(found, NODE)
    return out.select(*NODE, "parent_conv_id", "n_convs", "n_children", (F.col("leaf") + F.col("below_leaf")).alias("n_leaves"), (F.col("saved") + F.col("below_saved")).alias("saved_tokens"), "ends_sha256")
