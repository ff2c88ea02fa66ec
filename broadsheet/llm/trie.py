"""The prefix trie of conversations, from padded matrices of turn ids in range shards.

Each conversation is a path of turn ids (126 bits of two hashes of role and text). Paths are range-partitioned, so what
begins alike lies together. A shard lays its paths out as a padded matrix, sorts its rows (``lexsort``), marks where a
column differs from the row above and carries the marks on to later columns (``logical_or.accumulate``): a mark is the
start of a node, and ``reduceat`` over the starts aggregates each depth. Columns come in blocks of WIDTH; a later block
holds only the rows that reach it, with the node reached so far as its first key, so one long path pads nobody else.

Only nodes on the path of a shard's first or last row can go on in another shard. They leave the shard as partial
sums; FAN shards at a time are merged, whose inner nodes are then whole, until one is left. Identical paths are told
apart by conversation for the partitioning, so that thousands of copies spread over shards and meet again as one
partial row a shard and depth.

Defined results: turns with equal numbers follow each other by their hash; turns without a conversation id belong to
none and are left out; null roles and texts are empty; an empty table has no nodes, not even a root. A conversation's
hashes (20 bytes a turn, without its texts) are held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.scratch import drop_scratch, materialize

#: Columns of a matrix.
WIDTH = 16
#: Turns that a shard is meant to hold.
SHARD_TURNS = 500_000
#: Shards merged at once.
FAN = 64

NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "_shard long, _key binary, _parent binary, _chars long, _first boolean, _last boolean, _ends string"
)
_ARROW = pa.schema([
    *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string()),
    ("_shard", pa.int64()), ("_key", pa.binary()), ("_parent", pa.binary()), ("_chars", pa.int64()), ("_first", pa.bool_()), ("_last", pa.bool_()),
    ("_ends", pa.string()),
])


def turn_paths(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, path): the turns of each conversation in order, each as struct<hi, lo, chars>."""
    words = [F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))]
    mark = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 1)
    turn = F.struct(
        F.col(order).isNotNull().alias("known"), F.col(order).alias("turn"), mark(*words).alias("hi"), mark(F.lit(1), *words).alias("lo"),
        F.length(words[1]).alias("chars"),
    )
    found = turns.filter(F.col(key).isNotNull()).select(F.col(key).alias("conv_id"), turn.alias("_turn"))
    paths = found.groupBy("conv_id").agg(F.array_sort(F.collect_list("_turn")).alias("path"))
    return paths.withColumn("path", F.transform("path", lambda t: F.struct(t["hi"], t["lo"], t["chars"])))


def with_shared_heads(paths: DataFrame, base: Column, head: Column, longest: int) -> DataFrame:
    """``paths`` whose first ``head`` turns (at most ``longest``) are those of the conversation ``base``, none if there is none."""
    heads = paths.select(F.col("conv_id").alias("_base"), F.slice("path", 1, longest).alias("_start"))
    own = paths.withColumn("_base", base).withColumn("_head", head)
    joined = own.join(heads.join(own.select("_base").distinct(), "_base", "left_semi"), "_base", "left")
    start = F.coalesce(F.slice("_start", F.lit(1), F.col("_head")), F.slice("path", 1, 0))
    return joined.select("conv_id", F.concat(start, F.slice("path", F.col("_head") + 1, F.size("path"))).alias("path"))


def _extreme(pick, starts, sizes, hi, lo) -> int:
    """The row whose path is the first (``pick`` is min) or the last (max) of all; a path comes before its continuations."""
    rows, depth = np.arange(len(sizes)), 0
    while (sizes[rows] > depth).any():
        for ids in (hi, lo):
            here = sizes[rows] > depth
            found = np.full(len(rows), -1)
            found[here] = ids[starts[rows[here]] + depth]
            rows = rows[found == pick(found)]
        depth += 1
    return int(rows[0])


def _levels(conv, starts, sizes, hi, lo, chars, edges) -> list[dict]:
    """For each depth its nodes: low (smallest member), n, chars, parent, ends (row and node) and, for each edge row, its node."""
    node = np.zeros(len(conv), np.int64)
    done = np.flatnonzero(sizes == 0)
    root = {"low": np.array([conv.min()]), "n": np.array([len(conv)]), "chars": np.zeros(1, np.int64), "parent": None}
    levels = [root | {"ends": (done, node[done]), "edges": [0] * len(edges)}]
    rows, depth = np.flatnonzero(sizes > 0), 0
    while len(rows):
        width = int(min(WIDTH, sizes[rows].max() - depth))
        places = depth + np.arange(width)
        there = places < sizes[rows, None]
        at = np.where(there, starts[rows, None] + places, 0)
        a, b = np.where(there, hi[at], -1), np.where(there, lo[at], -1)
        order = np.lexsort([ids[:, c] for c in reversed(range(width)) for ids in (b, a)] + [node[rows]])
        rows, there, at, a, b = rows[order], there[order], at[order], a[order], b[order]
        change = np.ones(there.shape, bool)
        change[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        change[1:, 0] |= node[rows[1:]] != node[rows[:-1]]
        np.logical_or.accumulate(change, axis=1, out=change)
        for c in range(width):
            here = np.flatnonzero(there[:, c])
            new = np.flatnonzero(change[here, c])
            members, heads = rows[here], here[new]
            level = {
                "low": np.minimum.reduceat(conv[members], new), "n": np.add.reduceat(np.ones(len(here), np.int64), new),
                "chars": chars[at[heads, c]], "parent": node[rows[heads]],
            }
            node[members] = np.cumsum(change[here, c]) - 1
            done = members[sizes[members] == depth + c + 1]
            levels.append(level | {"ends": (done, node[done]), "edges": [int(node[e]) if sizes[e] > depth + c else None for e in edges]})
        depth += width
        rows = np.sort(rows[sizes[rows] > depth])
    return levels


def _joined_ends(conv: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> dict[int, str]:
    """By node the conversations that end there, ascending, joined by commas."""
    rows, nodes = ends
    if not len(rows):
        return {}
    order = np.lexsort([conv[rows], nodes])
    ids, nodes = conv[rows][order], nodes[order]
    cuts = np.flatnonzero(np.diff(nodes)) + 1
    return {int(nodes[a]): ",".join(map(str, ids[a:b].tolist())) for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True)}


def _add_up(child: dict, parent: dict) -> None:
    """Sums of the whole nodes of one depth for their parents, whose children lie together."""
    new = np.flatnonzero(np.diff(child["parent"], prepend=-1))
    whole = child["whole"]
    for name, value in (("saved", child["saved"]), ("leaves", child["leaves"]), ("children", np.ones(len(whole), np.int64))):
        parent[name][child["parent"][new]] = np.add.reduceat(np.where(whole, value, 0), new)


def shard_nodes(conv, starts, sizes, hi, lo, chars, shard: int) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard in the form NODE: whole ones, and partial ones (``_key`` given) on its first and last path."""
    edges = [_extreme(np.min, starts, sizes, hi, lo), _extreme(np.max, starts, sizes, hi, lo)]
    levels = _levels(conv, starts, sizes, hi, lo, chars, edges)
    for level in levels:
        n = len(level["n"])
        level["whole"] = np.ones(n, bool)
        level["whole"][[e for e in level["edges"] if e is not None]] = False
        level |= {name: np.zeros(n, np.int64) for name in ("saved", "leaves", "children")}
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        whole = level["whole"]
        level["saved"] += np.where(whole, (level["n"] - 1) * level["chars"], 0)
        level["leaves"] += np.where(whole & (level["children"] == 0), 1, 0)
        if depth:
            _add_up(level, levels[depth - 1])
    keys: list[dict[int, bytes]] = [{} for _ in levels]
    for row in edges:
        path = hashlib.md5(usedforsecurity=False)
        for depth in range(int(sizes[row]) + 1):
            if depth:
                at = starts[row] + depth - 1
                path.update(int(hi[at]).to_bytes(8, "big") + int(lo[at]).to_bytes(8, "big"))
            keys[depth][levels[depth]["edges"][edges.index(row)]] = path.digest()
    for depth, level in enumerate(levels):
        n, whole = len(level["n"]), level["whole"]
        ends, key, parent = [NO_ENDS] * n, [None] * n, [None] * n
        blocks = [None] * n
        for node, joined in _joined_ends(conv, level["ends"]).items():
            if whole[node]:
                ends[node] = hashlib.sha256(joined.encode()).hexdigest()
            else:
                blocks[node] = joined
        above = np.full(n, 0), np.zeros(n, bool)
        if depth:
            up = level["parent"]
            above = levels[depth - 1]["low"][up], levels[depth - 1]["whole"][up]
            for node in np.flatnonzero(~above[1]).tolist():
                parent[node] = keys[depth - 1][int(up[node])]
        for node, digest in keys[depth].items():
            key[node], ends[node] = digest, None
        flags = [pa.array(np.isin(np.arange(n), [e] if e is not None else [])) for e in level["edges"]]
        columns = [
            pa.array(level["low"]), pa.array(np.full(n, depth)), pa.array(above[0], mask=~above[1]), pa.array(level["n"]), pa.array(level["children"]),
            pa.array(level["leaves"]), pa.array(level["saved"]), pa.array(ends, pa.string()), pa.array(np.full(n, shard)), pa.array(key, pa.binary()),
            pa.array(parent, pa.binary()), pa.array(level["chars"].astype(np.int64)), *flags, pa.array(blocks, pa.string()),
        ]
        yield from pa.Table.from_arrays(columns, schema=_ARROW).to_batches(max_chunksize=50_000)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches) or [pa.RecordBatch.from_pylist([], _PATHS)])
    if table.num_rows:
        paths = table.column("path").combine_chunks()
        if isinstance(paths, pa.ChunkedArray):
            paths = pa.concat_arrays(paths.chunks)
        ends = paths.offsets.to_numpy()
        hi, lo, chars = (paths.values.field(i).to_numpy() for i in range(3))
        if not len(hi):  # a turnless shard
            hi = lo = chars = np.zeros(1, np.int64)
        conv = table.column("conv_id").to_numpy()
        yield from shard_nodes(conv, ends[:-1].astype(np.int64), np.diff(ends).astype(np.int64), hi, lo, chars, TaskContext.get().partitionId())


_PATHS = pa.schema([("conv_id", pa.int64()), ("path", pa.list_(pa.struct([("hi", pa.int64()), ("lo", pa.int64()), ("chars", pa.int32())])))])


def _merger(final: bool):
    def merge(table: pa.Table) -> pa.Table:
        """Partial nodes of neighbouring shards as nodes of one; those that cannot go on in another are whole."""
        rows = table.to_pylist()
        low, high = min(r["_shard"] for r in rows), max(r["_shard"] for r in rows)
        nodes: dict[bytes, dict] = {}
        for r in rows:
            node = nodes.setdefault(r["_key"], r | dict.fromkeys(("n_convs", "n_children", "n_leaves", "saved_tokens"), 0) | {"first": False, "last": False})
            for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                node[name] += r[name]
            node["conv_id"] = min(node["conv_id"], r["conv_id"])
            node["first"] |= r["_first"] and r["_shard"] == low
            node["last"] |= r["_last"] and r["_shard"] == high
        for node in sorted(nodes.values(), key=lambda v: -v["depth"]):
            node |= {"_shard": node["_unit"], "_first": node["first"], "_last": node["last"], "ends_sha256": None, "_ends": None}
            node["_done"] = final or not (node["first"] or node["last"])
            if node["_done"]:
                node["saved_tokens"] += (node["n_convs"] - 1) * node["_chars"]
                node["n_leaves"] += node["n_children"] == 0
                if node["_parent"] is not None:
                    above = nodes[node["_parent"]]
                    for name, value in (("n_children", 1), ("n_leaves", node["n_leaves"]), ("saved_tokens", node["saved_tokens"])):
                        above[name] += value
        return pa.Table.from_pylist(list(nodes.values()), _ARROW.append(pa.field("_unit", pa.int64())).append(pa.field("_done", pa.bool_())))

    return merge


def _recombined(partial: DataFrame, shards: int) -> DataFrame:
    """The boundary nodes of all shards, whole."""
    found = None
    while True:
        units = -(-shards // FAN)
        grouped = partial.withColumn("_unit", F.expr(f"_shard div {FAN}")).withColumn("_done", F.lit(False)).groupBy("_unit")
        merged = materialize(grouped.applyInArrow(_merger(units <= 1), NODE + ", _unit long, _done boolean"), "merged")
        whole, partial, shards = merged.filter("_done"), merged.filter("NOT _done").drop("_unit", "_done"), units
        found = whole if found is None else found.union(whole)
        if units <= 1:
            return found


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks of conversation ids, hashed as one text per node as they stream by."""
    key, state = None, None
    one = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["_key", "_sha"])
    for batch in batches:
        for k, ends in zip(batch.column(0), batch.column(1), strict=True):
            if state is None or k.as_py() != key:
                if state is not None:
                    yield one()
                key, state = k.as_py(), hashlib.sha256(ends.as_py().encode())
            else:
                state.update(b"," + ends.as_py().encode())
    if state is not None:
        yield one()


def prefix_trie(paths: DataFrame) -> DataFrame:
    """A row per node of the trie of ``paths`` (conv_id, path as in :func:`turn_paths`, one row a conversation)."""
    spark = paths.sparkSession
    kept = materialize(paths, "paths")
    turns = kept.agg(F.sum(F.size("path"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    dealt = kept.repartitionByRange(shards, F.transform("path", lambda t: F.struct(t["hi"], t["lo"])), "conv_id")
    nodes = materialize(dealt.mapInArrow(_shards, NODE), "nodes")
    drop_scratch(kept)
    partial = nodes.filter("_key IS NOT NULL")
    edge = _recombined(partial.withColumn("_ends", F.lit(None).cast("string")), (partial.agg(F.max("_shard")).first()[0] or 0) + 1)
    blocks = partial.filter("_ends IS NOT NULL").select("_key", "_ends", "_shard")  # a node's conversations ascend with the shards
    ordered = blocks.repartition("_key").sortWithinPartitions("_key", "_shard").select("_key", "_ends")
    ends = ordered.mapInArrow(_hashed, "_key binary, _sha string")

    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = nodes.filter("_key IS NULL")
    known = inner.filter("_parent IS NULL").select(shown)
    lowest = edge.select(F.col("_key").alias("_parent"), F.col("conv_id").alias("_above"))
    by_shard = partial.select("_shard", F.col("_key").alias("_parent")).join(lowest, "_parent")
    below = inner.filter("_parent IS NOT NULL").join(by_shard, ["_shard", "_parent"]).withColumn("parent_conv_id", F.col("_above"))
    joined = edge.join(lowest, "_parent", "left").join(ends, "_key", "left")
    top = joined.withColumn("parent_conv_id", F.col("_above")).withColumn("ends_sha256", F.coalesce("_sha", F.lit(NO_ENDS)))
    return known.unionByName(below.select(shown)).unionByName(top.select(shown))
