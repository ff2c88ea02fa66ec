"""Sharding by a hierarchical weighted hash tree (region, rack, shard), built-in functions only.

At every level a document draws one exponential variate per child, ``-ln(u) / weight`` with ``u``
hashed from its key and the child's name, and descends into the smallest. A child's weight is the sum
of the shard weights below it, so a change of weight moves documents only into (or out of) the subtree
whose weight changed. A shard that joins by :func:`grown`, as a region and rack of its own, takes rows into itself only;
so does each of :func:`layout` beyond its grid. Grids of different numbers are different trees, between which rows move.

Defined results: a null key is hashed like any other value; null or empty text has size 16; repeated
rows land in one shard under different slots; an empty table gives an empty result; extra columns pass
through, but one named like a result's column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.scratch import materialize, quoted, unused


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def layout(shards: int, regions: int = 4, racks: int = 2, per_rack: int = 5) -> list[Shard]:
    """The first regions * racks * per_rack shards fill the grid; each later one is its own region."""
    grid = []
    for number in range(shards):
        if number < regions * racks * per_rack:
            region, rest = divmod(number, racks * per_rack)
            grid.append(Shard(f"region{region}", f"region{region}/rack{rest // per_rack}", number))
        else:
            grid.append(Shard(f"added{number}", f"added{number}/rack0", number))
    return grid


def grown(shards: list[Shard], weight: float = 1.0) -> list[Shard]:
    """``shards`` and one more, numbered next, which joins as a region of its own."""
    number = max((s.number for s in shards), default=-1) + 1
    return [*shards, Shard(f"added{number}", f"added{number}/rack0", number, weight)]


def _least(key: Column, names: Column, weights: Column) -> Column:
    """The position (from 0) of the child with the smallest weighted draw; ties to the first."""
    def draw(name, at):
        u = (F.shiftrightunsigned(F.xxhash64(key, name), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        return F.struct((-F.log(u) / F.get(weights, at)).alias("draw"), at.alias("at"))

    return F.array_min(F.transform(names, draw))["at"]


def shard_of(key: Column, shards: list[Shard]) -> Column:
    """The shard number for ``key``; shards of weight 0 or less take nothing."""
    tree: dict[str, dict[str, list[Shard]]] = {}
    for s in shards:
        if s.weight > 0:
            tree.setdefault(s.region, {}).setdefault(s.rack, []).append(s)

    def below(children: dict, level):
        return F.array(*[level(k, v) for k, v in children.items()])

    regions, racks = list(tree), [list(r) for r in tree.values()]
    region_w = [sum(s.weight for rack in r.values() for s in rack) for r in tree.values()]
    rack_w = [[sum(s.weight for s in rack) for rack in r.values()] for r in tree.values()]
    leaves = [[rack for rack in r.values()] for r in tree.values()]

    def strings(xs):
        return F.array(*[F.lit(x) for x in xs])

    def numbers(xs):
        return F.array(*[F.lit(float(x)) for x in xs])

    region = _least(key, strings(regions), numbers(region_w))
    pick = F.array(*[
        F.struct(
            strings(racks[i]).alias("racks"), numbers(rack_w[i]).alias("weights"),
            F.array(*[
                F.struct(strings([f"{s.rack}/{s.number}" for s in rack]).alias("names"), numbers([s.weight for s in rack]).alias("weights"),
                         F.array(*[F.lit(s.number) for s in rack]).alias("numbers"))
                for rack in leaves[i]
            ]).alias("leaves"),
        )
        for i in range(len(regions))
    ])

    def leaf(rack):
        return F.get(rack["numbers"], _least(key, rack["names"], rack["weights"]))

    def in_region(r):
        return leaf_of(F.get(r["leaves"], _least(key, r["racks"], r["weights"])))

    def leaf_of(rack):
        return F.element_at(F.transform(F.array(rack), leaf), 1)

    return F.element_at(F.transform(F.array(F.get(pick, region)), in_region), 1)


def assign_shards(docs: DataFrame, shards: list[Shard], key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """``docs`` with the column ``shard``; no shuffle."""
    return docs.withColumn(shard, shard_of(F.col(quoted(key)), shards))


def with_slots(sharded: DataFrame, shard: str = "shard", slot: str = "slot", key: str = "doc_id") -> DataFrame:
    """Numbers the rows of each shard from 0 without a gap.

    The rows are written once with the partition they were read in. Rows are numbered within
    (shard, partition), a group no larger than one scan partition, and the counts of earlier
    partitions are added; so no shard, however large, is sorted in one task.
    """
    part, at, before, n = unused([*sharded.columns, slot], "_part", "_at", "_before", "_n")
    kept = materialize(sharded.drop(quoted(slot)).withColumn(part, F.spark_partition_id()), "sharded")
    counts = kept.groupBy(quoted(shard), part).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(quoted(shard)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(quoted(shard), part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    within = Window.partitionBy(quoted(shard), part).orderBy(quoted(key))
    numbered = kept.withColumn(at, F.row_number().over(within) - 1).join(offsets, [shard, part])
    result = numbered.withColumn(slot, (F.col(before) + F.col(at)).cast("long"))
    return result.select(*[F.col(quoted(c)) for c in sharded.columns if c != slot], quoted(slot))


def write_shards(sharded: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per shard under ``path``."""
    sharded.write.mode("overwrite").partitionBy(shard).parquet(path)
