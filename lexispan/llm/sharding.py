"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts.

Equal texts form one group that stays together. Groups are dealt into hash cells
of bounded size; inside a cell the differencing method keeps partial partitions
(one load for each shard) and repeatedly combines the two with the largest spread,
the heavier loads of one against the lighter loads of the other. What remains of
a cell is one partial partition.

Cells are balanced against each other in bundles: the last cell of a bundle is
differenced after the others and starts from the loads that they have left, so what
the cells leave over is taken up there and does not add up.

Groups that alone weigh more than ``1 / HEAVY`` of a shard are few by definition
(at most ``HEAVY`` for each shard), so they are placed first, together, and every
cell starts from its equal share of the difference they leave: ordinary groups
fill the shards that the heavy ones left light.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispan.llm.common import cells_for, checkpointed

SHARDS = 40
ROW_OVERHEAD = 16
GROUPS_PER_CELL = 20_000
ROWS_PER_CELL = 100_000
HEAVY = 16
BUNDLE = 100  # cells whose loads are evened out by their last one


def differencing(sizes: np.ndarray, shards: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each item, load of each shard) by Karmarkar-Karp differencing.

    ``start``: loads that the shards have already; it takes part as a partial
    partition of its own and fixes which part is which shard.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(shards) if start is None else np.asarray(start, float)
    empty = np.zeros(shards - 1)
    loads, parents = [], [None] * n
    for s in sizes:
        loads.append(np.append(empty, float(s)))
    if start is not None:
        order = np.argsort(start, kind="stable")
        loads.append(np.asarray(start, float)[order])
        parents.append(None)
    # a node's loads ascend; only differences matter, so the least load is taken off the spread
    heap = [(-(x[-1] - x[0]), k) for k, x in enumerate(loads)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int, np.ndarray]] = {}
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = loads[a] + loads[b][::-1]
        order = np.argsort(total, kind="stable")
        k = len(loads)
        children[k] = (a, b, order)
        loads.append(total[order])
        loads[a] = loads[b] = None
        heapq.heappush(heap, (-(loads[k][-1] - loads[k][0]), k))
    root = heap[0][1]
    leaf = np.zeros(n + (start is not None), np.int64)
    todo = [(root, np.arange(shards))]
    fixed = None
    while todo:
        k, to = todo.pop()
        if k not in children:
            leaf[k] = to[-1]
            if start is not None and k == n:
                fixed = to
            continue
        a, b, order = children[k]
        rank = np.empty(shards, np.int64)
        rank[order] = to  # position before sorting -> part of the root
        todo.append((a, rank))
        todo.append((b, rank[::-1]))
    final = loads[root]
    if start is None:
        return leaf[:n], final
    part_to_shard = np.empty(shards, np.int64)
    part_to_shard[fixed] = np.argsort(start, kind="stable")
    out = np.empty(shards)
    out[part_to_shard] = final
    return part_to_shard[leaf[:n]], out


def _balanced(groups: DataFrame, shards: int, cells: int) -> DataFrame:
    """``g1, g2, size`` -> ``g1, g2, shard``: heavy groups first, then every cell."""
    total, n_groups = groups.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not n_groups:
        return groups.select("g1", "g2", F.lit(0).alias("shard"))
    limit = int(total) / (shards * HEAVY)
    # at most shards * HEAVY groups can exceed the limit: a proven bound
    heavy = groups.where(F.col("size") > limit).orderBy("g1", "g2").select("g1", "g2", "size").toPandas()
    place, start = differencing(heavy["size"].to_numpy(), shards)
    share = (start - start.min()) / cells

    def divided(table: pa.Table, begin: np.ndarray) -> pa.Table:
        table = table.sort_by([("g1", "ascending"), ("g2", "ascending")])
        shard, _ = differencing(table["size"].to_numpy(), shards, begin)
        return pa.table({"g1": table["g1"], "g2": table["g2"], "bundle": table["bundle"], "size": table["size"], "shard": pa.array(shard, pa.int32())})

    def cell(table: pa.Table) -> pa.Table:
        return divided(table, share)

    def last(table: pa.Table, others: pa.Table) -> pa.Table:
        """The bundle's last cell, given the loads of its other cells."""
        if not table.num_rows:
            return divided(groups_schema.empty_table(), share)
        begin = share * table["in_bundle"][0].as_py()
        begin[others["shard"].to_numpy()] += others["load"].to_numpy()
        return divided(table, begin)

    kinds = "g1 long, g2 long, bundle long, size long, shard int"
    groups_schema = pa.schema([("g1", pa.int64()), ("g2", pa.int64()), ("bundle", pa.int64()), ("size", pa.int64())])
    at = F.pmod(F.col("g1"), F.lit(cells))
    in_bundle = F.least(F.lit(BUNDLE), F.lit(cells) - F.col("bundle") * BUNDLE)
    light = groups.where(F.col("size") <= limit).select("g1", "g2", F.col("size").cast("long").alias("size"), at.alias("cell"), F.floor(at / BUNDLE).cast("long").alias("bundle"))
    light = light.withColumn("in_bundle", in_bundle.cast("long"))
    is_last = F.col("cell") == F.col("bundle") * BUNDLE + F.col("in_bundle") - 1
    before = checkpointed(light.where(~is_last).groupBy("cell").applyInArrow(cell, kinds))
    loads = before.groupBy("bundle", "shard").agg(F.sum("size").cast("double").alias("load"))
    after = light.where(is_last).groupBy("bundle").cogroup(loads.groupBy("bundle")).applyInArrow(last, kinds)
    light = before.unionByName(after).select("g1", "g2", "shard")
    if not len(heavy):
        return light
    rows = [(int(a), int(b), int(s)) for a, b, s in zip(heavy["g1"], heavy["g2"], place, strict=True)]
    return light.unionByName(groups.sparkSession.createDataFrame(rows, "g1 long, g2 long, shard int"))


def shard_documents(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    The law is ``bytes``: the shards' sizes are as equal as indivisible groups
    allow, so ``grown_shard`` is null. Size is the UTF-8 length plus 16; a null text
    counts as empty and belongs to the group of empty texts. Slots are gapless from
    0 in each shard, in an order fixed by hash cell, id and text. Null and repeated
    ids are rows like any other; extra columns are ignored; an empty table gives an
    empty result. A single group above a shard's fair share makes its shard larger:
    groups are never divided.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(text)
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(digest).alias("g1"),
        F.xxhash64(F.concat(F.lit("2"), digest)).alias("g2"),
    )
    rows = checkpointed(rows)
    n = rows.count()
    groups = checkpointed(rows.groupBy("g1", "g2").agg(F.sum("size").alias("size")))
    placed = checkpointed(_balanced(groups, shards, cells_for(groups.count(), GROUPS_PER_CELL)))
    # one placed row a group: a hot group's rows are split by the adaptive skew join
    rows = rows.join(placed.hint("merge"), ["g1", "g2"])
    cells = cells_for(n, ROWS_PER_CELL // shards, shards)
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)).cast("int"))
    rows = checkpointed(rows.select("doc_id", "size", "text_crc32", "shard", "cell", "g1", "g2"))
    counts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")
    offsets = counts.select("shard", "cell", before.alias("before"))
    order = Window.partitionBy("shard", "cell").orderBy("doc_id", "g1", "g2")
    slotted = rows.withColumn("at", F.row_number().over(order) - 1).join(offsets, ["shard", "cell"])
    return slotted.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
