"""Resharding with the fewest moved bytes: a minimum-cost flow between old and new shards.

Old shard sizes are supplies, new capacities demands, and moving a byte to another shard
costs one while leaving it costs nothing. Every path that saves cost is a stay, so the flow
first lets each shard keep what its capacity allows, and the surplus then fills the gaps;
successive shortest paths give the integral optimum. The flow graph has shards as nodes, so
its size does not depend on the rows. Within an old shard rows are laid out by a running sum
of their sizes, large rows first, and cut where the flow says: what stays comes first, then
the blocks for each receiving shard. Cuts then fall between small rows.

A row without an old shard is refused. Null texts weigh the fixed overhead alone; repeated
rows are rows of their own; a very long text is one row and moves whole; an empty table gives
no rows. Rows equal in id and text, null ids included, share a range of the layout.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlscout.llm.common import shared_folder, shuffles_dropped, stored

ROW_BYTES = 8
PLACEMENT = ("doc_id", "size", "old_shard", "shard", "slot")
RANGES = 256  # parts of a size class in a shard's layout; a task numbers the rows of one


def row_size(column: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(f"`{column}`")), F.lit(0)) + ROW_BYTES).cast("long")


def least_moves(sizes: dict[int, int], capacities: dict[int, int]) -> list[tuple[int, int, int]]:
    """Flows (old shard, new shard, bytes) of minimum cost that fill the capacities.

    Total capacity must be the total size. Successive shortest paths with potentials; nodes
    are the shards, so this runs on the driver in the number of shards.
    """
    if sum(sizes.values()) != sum(capacities.values()):
        raise ValueError("capacities must add up to the bytes there are")
    source, sink = ("s",), ("t",)
    graph: dict[tuple, dict[tuple, list[int]]] = {source: {}, sink: {}}

    def arc(a: tuple, b: tuple, room: int, cost: int) -> None:
        graph.setdefault(a, {})[b] = [room, cost]
        graph.setdefault(b, {})[a] = [0, -cost]

    for old, size in sizes.items():
        arc(source, ("old", old), size, 0)
        for new in capacities:
            arc(("old", old), ("new", new), size, int(old != new))
    for new, room in capacities.items():
        arc(("new", new), sink, room, 0)
    potential = dict.fromkeys(graph, 0)
    while True:
        distance, came = {source: 0}, {}
        heap = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > distance[a]:
                continue
            for b, (room, cost) in graph[a].items():
                step = d + cost + potential[a] - potential[b]
                if room > 0 and step < distance.get(b, 1 << 60):
                    distance[b], came[b] = step, a
                    heapq.heappush(heap, (step, b))
        if sink not in distance:
            break
        for a, d in distance.items():
            potential[a] += d
        path, b = [], sink
        while b != source:
            path.append((came[b], b))
            b = came[b]
        amount = min(graph[a][b][0] for a, b in path)
        for a, b in path:
            graph[a][b][0] -= amount
            graph[b][a][0] += amount
    return [
        (old, new, graph[("new", new)][("old", old)][0])
        for old in sizes
        for new in capacities
        if graph[("new", new)][("old", old)][0] > 0
    ]


def even_capacities(total: int, shards: int) -> dict[int, int]:
    return {s: total // shards + (s < total % shards) for s in range(shards)}


def _rows(df: DataFrame, old_shard: Column, key: str, carry: list[str]) -> DataFrame:
    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        row_size().alias("size"),
        old_shard.cast("int").alias("old_shard"),
        F.xxhash64(F.col(f"`{key}`"), F.col("text")).alias("_h"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row")] if carry else []),
    )
    # large rows first: the class orders by powers of two, the hash spreads within
    rows = rows.withColumn("_class", (63 - F.floor(F.log2("size"))).cast("int"))
    return rows.withColumn("_range", F.col("_class") * RANGES + F.pmod("_h", F.lit(RANGES))).drop("_class")


def _with_shard(rows: DataFrame, starts: DataFrame, pieces: DataFrame) -> DataFrame:
    """Each row's middle byte in its old shard, and the new shard whose piece holds it."""
    within = Window.partitionBy("old_shard", "_range").orderBy("_h", "doc_id", "size")
    placed = rows.join(starts, ["old_shard", "_range"]).withColumn(
        "_middle",
        F.col("_start")
        + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
        - F.ceil(F.col("size") / 2),
    )
    found = (
        (F.col("old_shard") == F.col("_old"))
        & (F.col("_middle") >= F.col("_from"))
        & (F.col("_middle") < F.col("_to"))
    )
    return placed.join(F.broadcast(pieces), found).drop("_old", "_from", "_to", "_start")


def _layout(rows: DataFrame, capacities: dict[int, int] | int) -> tuple[DataFrame, DataFrame]:
    """From the sizes alone: (old_shard, _range, _start, _first) and the pieces of the flow.

    One row per old shard and range, however many rows there are; ``_first`` maps each shard
    that takes from the range to the slot of the first row it takes.
    """
    small = stored(rows.drop("_row"), "sizes")
    ranges = stored(small.groupBy("old_shard", "_range").agg(F.sum("size").alias("_bytes")), "ranges")
    sizes = {r[0]: r[1] for r in ranges.groupBy("old_shard").agg(F.sum("_bytes")).collect()}
    if None in sizes:
        raise ValueError("every row needs an old shard, but there are rows with none")
    if isinstance(capacities, int):
        capacities = even_capacities(sum(sizes.values()), capacities)
    cuts, begin = [], {}
    for old, new, amount in sorted(
        least_moves(sizes, capacities), key=lambda m: (m[0], m[0] != m[1], m[1])
    ):
        cuts.append((old, new, begin.get(old, 0), begin.get(old, 0) + amount))
        begin[old] = begin.get(old, 0) + amount
    # at most old shards + new shards pieces, as a flow of minimum cost is a forest
    pieces = rows.sparkSession.createDataFrame(cuts, "_old int, shard int, _from bigint, _to bigint")
    by_range = Window.partitionBy("old_shard").orderBy("_range")
    starts = ranges.withColumn("_start", F.sum("_bytes").over(by_range) - F.col("_bytes")).drop("_bytes")
    # slots: rows of the new shard in earlier blocks, then the place within the block
    blocks = _with_shard(small, starts, pieces).groupBy("shard", "old_shard", "_range").agg(
        F.count("*").alias("_n")
    )
    by_block = Window.partitionBy("shard").orderBy("old_shard", "_range")
    offsets = blocks.withColumn("_first", F.sum("_n").over(by_block) - F.col("_n"))
    taken = F.map_from_entries(F.collect_list(F.struct("shard", "_first"))).alias("_first")
    firsts = offsets.groupBy("old_shard", "_range").agg(taken)
    return stored(starts.join(firsts, ["old_shard", "_range"]), "layout"), pieces


def _placed(rows: DataFrame, layout: DataFrame, pieces: DataFrame) -> DataFrame:
    # both windows and the join are dealt by old shard and range, so rows travel once
    inside = Window.partitionBy("shard", "old_shard", "_range").orderBy("_middle")
    slot = F.element_at("_first", F.col("shard")) + F.row_number().over(inside) - 1
    carried = ["_row"] if "_row" in rows.columns else []
    return _with_shard(rows, layout, pieces).select(
        "doc_id", "size", "old_shard", "shard", slot.cast("long").alias("slot"), *carried
    )


def reshard(
    df: DataFrame, old_shard: Column, capacities: dict[int, int] | int, key: str = "doc_id"
) -> DataFrame:
    """Per row (doc_id, size, old_shard, shard, slot); texts do not travel.

    ``capacities`` are bytes by new shard, or a number of shards of equal bytes. Slots count
    from 0 without gaps in the order of the layout. A row goes where its middle byte lies.
    """
    rows = _rows(df, old_shard, key, [])
    return _placed(rows, *_layout(rows, capacities))


def rewrite(
    df: DataFrame,
    old_shard: Column,
    capacities: dict[int, int] | int,
    folder: str,
    *,
    key: str = "doc_id",
    everything: bool = False,
) -> list[int]:
    """:func:`reshard` and :func:`write_shards` at once; whole rows are shuffled a single time.

    The layout is found from sizes alone. Columns of ``df`` named size, shard, slot or
    old_shard give way to those of the placement.
    """
    rows = _rows(df, old_shard, key, df.columns)
    layout, pieces = _layout(rows, capacities)
    blocks = layout.select("old_shard", F.explode("_first").alias("shard", "_"))
    names = _affected(blocks, everything)
    placed = _placed(rows, layout, pieces).filter(F.col("shard").isin(names))
    own = [F.col(f"_row.`{c}`") for c in df.columns if c not in (*PLACEMENT, key)]
    _save(placed.select(*PLACEMENT, *own), folder)
    return names


def _affected(placed: DataFrame, everything: bool) -> list[int]:
    chosen = placed if everything else placed.filter("old_shard <> shard")
    shards = chosen.select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    return sorted(r[0] for r in shards.collect())  # at most old + new shards


def _save(rows: DataFrame, folder: str) -> None:
    with shuffles_dropped(rows.sparkSession):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "shard"
        ).parquet(folder)


def write_shards(
    df: DataFrame, placed: DataFrame, folder: str, *, key: str = "doc_id", everything: bool = False
) -> list[int]:
    """Write the files of the shards whose rows changed and return those shards.

    ``placed`` is :func:`reshard`'s result for the rows of ``df``, joined by id; :func:`rewrite`
    does both without that join. A shard that neither gives
    nor takes a row keeps its files, as only affected partitions are overwritten;
    ``everything`` writes all, for a folder without files.
    """
    names = _affected(placed, everything)
    own = [c for c in df.columns if c not in (*PLACEMENT, key)]
    # repeated rows are told apart by a number, so that the join keeps their count
    body = df.select(F.col(f"`{key}`").cast("long").alias("_id"), *[F.col(f"`{c}`") for c in own])
    same = Window.partitionBy("_id").orderBy(F.octet_length("text"))
    body = body.withColumn("_copy", F.row_number().over(same))
    copy = Window.partitionBy("doc_id").orderBy("size")
    rows = placed.withColumn("_copy", F.row_number().over(copy)).filter(F.col("shard").isin(names))
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & rows["_copy"].eqNullSafe(body["_copy"])
    rows = rows.join(body, match).drop("_id", "_copy")
    # the shard and a range of slots deal the rows out, so that a shard is several files
    rows = rows.repartition("shard", F.floor(F.col("slot") / 5_000))
    _save(rows, folder)
    return names


def rewritten(df: DataFrame, old_shard: Column, shards: int) -> DataFrame:
    """Reshard, write every shard to a new folder and return the files' rows."""
    folder = shared_folder(df.sparkSession, "shards")
    if not rewrite(df, old_shard, shards, folder, everything=True):
        empty = df.limit(0).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
        kinds = {"size": "long", "old_shard": "int", "shard": "int", "slot": "long"}
        return empty.select("*", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    return df.sparkSession.read.parquet(folder)
