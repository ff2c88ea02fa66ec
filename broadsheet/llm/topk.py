"""Exact top-k search by tiled matrix products.

Vectors are packed into blocks of at most ``BLOCK`` rows, queries likewise; each pair of a query block
and a candidate shard is one tile: a matrix product, of which only the best k per query are kept. The
short lists of a query are then merged in a tree, ``FAN`` at a time, so no task holds more than
``FAN`` * k entries of a query whatever the number of shards.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id,
take no part; vectors meet only vectors of their own length (empty ones score 0); ties go to the smaller
id; rows that share the query's id are its own and left out; rows that repeat another id are candidates
each; query rows that repeat an id get a list each; with fewer than k candidates all are returned; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.scratch import materialize

BLOCK = 4096
#: Queries of a tile multiplied at a time.
SLICE = 256
#: Lists merged by one group of a round.
FAN = 16


def quantize(vector: Column, scale: int = 64) -> Column:
    """array<long>: floor(scale * x) of every component x as double; null where the vector takes no part."""
    x = vector.cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(sound, F.transform(x, lambda v: F.floor(v * scale)))


def _narrowest(values: np.ndarray) -> str:
    """The least wide integer type that holds ``values``."""
    low, high = values.min(initial=0), values.max(initial=0)
    return next(f"<i{n}" for n in (1, 2, 4, 8) if low >= -(1 << 8 * n - 1) and high < 1 << 8 * n - 1)


def _blocks(vectors: DataFrame, block: int) -> DataFrame:
    """(_dim, _block, _bytes (of a component), _ids binary, _matrix binary) of ``vectors`` (_id long, _x array<long>)."""
    sizes = vectors.groupBy(F.size("_x").alias("_dim")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_of"))
    dealt = vectors.withColumn("_dim", F.size("_x")).withColumn("_deal", F.monotonically_increasing_id())
    keyed = dealt.join(sizes, "_dim").withColumn("_block", F.pmod(F.xxhash64("_deal"), "_of").cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("_id")
        xs = table.column("_x").combine_chunks()
        values = xs.flatten().to_numpy()
        values = values.astype(_narrowest(values))
        ids = table.column("_id").to_numpy().astype("<i8")
        return pa.table({
            "_dim": pa.array([table.column("_dim")[0].as_py()], pa.int32()), "_block": pa.array([table.column("_block")[0].as_py()], pa.int32()),
            "_bytes": pa.array([values.itemsize], pa.int32()), "_ids": pa.array([ids.tobytes()], pa.binary()), "_matrix": pa.array([values.tobytes()], pa.binary()),
        })

    return keyed.select("_dim", "_block", "_id", "_x").groupBy("_dim", "_block").applyInArrow(
        pack, "_dim int, _block int, _bytes int, _ids binary, _matrix binary"
    )


def tile_best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
    """Per query the k best rows by inner product, ties to the smaller id; its own id left out.

    ``row_ids`` ascend. Yields (query's place, ids, scores). Products are exact: in floating point while they
    fit its 53 bits, else in 64-bit integers. ``SLICE`` queries are multiplied at a time.
    """
    n, dim = rows.shape
    peak = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(rows.astype(np.float64)).max(initial=0)) * max(dim, 1)
    kind = np.float64 if peak < 2**53 else np.int64
    turned = np.ascontiguousarray(rows.T, kind)
    own_low, own_high = np.searchsorted(row_ids, query_ids, "left"), np.searchsorted(row_ids, query_ids, "right")
    for q in range(len(query_ids)):
        if q % SLICE == 0:
            scores = (queries[q : q + SLICE].astype(kind) @ turned).astype(np.int64)
        line, low, high = scores[q % SLICE], own_low[q], own_high[q]
        others = np.concatenate([np.arange(low), np.arange(high, n)]) if high > low else None
        line = line if others is None else line[others]
        if len(line) > k:
            least = np.partition(line, len(line) - k)[len(line) - k]
            above = np.flatnonzero(line > least)
            best = np.concatenate([above, np.flatnonzero(line == least)[: k - len(above)]])
        else:
            best = np.arange(len(line))
        best = best[np.argsort(-line[best], kind="stable")]
        at = best if others is None else others[best]
        if len(at):
            yield q, row_ids[at], line[best]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, query_block: int = BLOCK) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long); both inputs have ``_id`` long and ``_x`` array<long>."""
    def sound(df):
        return df.filter("_id IS NOT NULL AND _x IS NOT NULL")

    shards = materialize(_blocks(sound(candidates), block), "shards")
    asked = materialize(_blocks(sound(queries), query_block), "queries")
    side = F.struct("_bytes", "_ids", "_matrix")
    shard_places = shards.groupBy("_dim").agg(F.collect_list("_block").alias("_meets"))
    query_places = asked.groupBy("_dim").agg(F.collect_list("_block").alias("_meets"))
    halves = (
        asked.join(shard_places, "_dim").select("_dim", F.col("_block").alias("_q"), F.explode("_meets").alias("_s"), F.lit(0).alias("_side"), side.alias("_part"))
    ).union(
        shards.join(query_places, "_dim").select("_dim", F.explode("_meets").alias("_q"), F.col("_block").alias("_s"), F.lit(1).alias("_side"), side.alias("_part"))
    )

    schema = pa.schema([
        ("query_id", pa.int64()), ("_dim", pa.int32()), ("_q", pa.int32()), ("_row", pa.int32()), ("_s", pa.int32()),
        ("_best", pa.list_(pa.struct([("neg", pa.int64()), ("vec_id", pa.int64())]))),
    ])

    def tile(table: pa.Table) -> pa.Table:
        parts = dict(zip(table.column("_side").to_pylist(), table.column("_part").to_pylist(), strict=True))
        if len(parts) < 2:
            return schema.empty_table()
        dim = table.column("_dim")[0].as_py()
        ids = [np.frombuffer(parts[s]["_ids"], "<i8") for s in (0, 1)]
        xs = [np.frombuffer(parts[s]["_matrix"], f"<i{parts[s]['_bytes']}").reshape(len(ids[s]), dim) for s in (0, 1)]
        found = list(tile_best(xs[0], ids[0], xs[1], ids[1], k))
        ends = np.cumsum([0, *[len(f[1]) for f in found]])
        entries = pa.StructArray.from_arrays(
            [pa.array(np.concatenate([-f[2] for f in found] or [np.empty(0, np.int64)])),
             pa.array(np.concatenate([f[1] for f in found] or [np.empty(0, np.int64)]))], ["neg", "vec_id"],
        )
        rows = np.array([f[0] for f in found], np.int64)
        places = [pa.array([table.column(c)[0].as_py()] * len(found), pa.int32()) for c in ("_dim", "_q", "_s")]
        columns = [pa.array(ids[0][rows]), *places[:2], pa.array(rows, pa.int32()), places[2], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)]
        return pa.table(columns, schema=schema)

    kind = "query_id long, _dim int, _q int, _row int, _s int, _best array<struct<neg:long,vec_id:long>>"
    lists = halves.groupBy("_dim", "_q", "_s").applyInArrow(tile, kind)
    width = shards.agg(F.coalesce(F.max("_block"), F.lit(0)) + 1).first()[0]
    while width > 1:
        group = F.floor(F.col("_s") / FAN).cast("int").alias("_s")
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("_best"))), 1, k)
        lists = lists.groupBy("query_id", "_dim", "_q", "_row", group).agg(merged.alias("_best"))
        width = -(-width // FAN)
    ranked = lists.select("query_id", F.posexplode("_best").alias("_at", "_hit"))
    return ranked.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_hit.vec_id").alias("vec_id"), (-F.col("_hit.neg")).alias("score"))
