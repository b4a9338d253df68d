"""Minimum-cost-flow resharding.

From the bytes that each old shard holds and the capacity that each new shard has, a flow decides how
many bytes go from where to where so that the fewest bytes move; documents are then cut into those
flows along a fixed order of blocks, and only files of shards that lose or gain rows are rewritten.

``reshard`` does the whole of it: rows keep all their columns through placement, the affected shards are
written from the placed rows (no join back on an id), and what it returns is read from the written files.

Block statistics (at most old shards x ``n_blocks`` rows, both parameters) are all that reaches the
driver; rows never do.  Slots number the rows of a new shard from 0 without gaps.

Defined cases: null text has no bytes (size 1); null ids and repeated rows are placed each for itself;
an empty table gives no rows; a null old shard counts as shard 0; sizes differ from the capacity by less
than one document for each of the at most ``old x new`` cuts.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import cut, quoted

#: Least and most blocks of an old shard, and the bytes a block should hold; a window sorts one block.
LEAST_BLOCKS, MOST_BLOCKS, BLOCK_BYTES = 256, 1 << 16, 64 << 20


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Successive shortest paths: flow[i][j] from source i to sink j that ships all supply at least cost."""
    n, m = len(supply), len(capacity)
    s, t, size = n + m, n + m + 1, n + m + 2
    graph: list[list[int]] = [[] for _ in range(size)]
    to: list[int] = []
    room: list[int] = []
    price: list[int] = []

    def edge(u: int, v: int, c: int, w: int) -> None:
        for a, b, cc, ww in ((u, v, c, w), (v, u, 0, -w)):
            graph[a].append(len(to))
            to.append(b)
            room.append(cc)
            price.append(ww)

    for i, x in enumerate(supply):
        edge(s, i, x, 0)
    first = len(to)
    for i in range(n):
        for j in range(m):
            edge(i, n + j, supply[i], cost[i][j])
    for j, x in enumerate(capacity):
        edge(n + j, t, x, 0)
    while True:
        best, via = [None] * size, [-1] * size
        best[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if room[e] and (best[to[e]] is None or best[u] + price[e] < best[to[e]]):
                    best[to[e]], via[to[e]] = best[u] + price[e], e
                    queue.append(to[e])
        if best[t] is None:
            break
        push, v = None, t
        while v != s:
            push = room[via[v]] if push is None else min(push, room[via[v]])
            v = to[via[v] ^ 1]
        v = t
        while v != s:
            room[via[v]] -= push
            room[via[v] ^ 1] += push
            v = to[via[v] ^ 1]
    return [[room[(first + 2 * (i * m + j)) ^ 1] for j in range(m)] for i in range(n)]


def even_capacity(total: int, n: int) -> list[int]:
    return [total // n + (j < total % n) for j in range(n)]


def _measures(text: str) -> list[Column]:
    """size and text_crc32 of a text."""
    b = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return [(F.octet_length(b) + 1).cast("long").alias("size"), F.crc32(b).alias("text_crc32")]


def place(
    docs: DataFrame,
    old_shard: Column,
    n_new: int,
    capacity: list[int] | None = None,
    n_blocks: int | None = None,
    n_old: int | None = None,
    whole: str | None = None,
) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot for every row of ``docs`` (doc_id, text).

    ``old_shard`` gives each row's present shard, 0 to ``n_old`` - 1 (default ``n_new``); others are an error.  Blocks
    number ``n_blocks``, by default so many that the largest old shard has ``BLOCK_BYTES`` in each.  With ``whole``, a new
    folder for the placed rows, each row also carries all its columns as ``row``; ``docs`` is then read twice."""
    spark = docs.sparkSession
    n_old = n_old or n_new
    if n_blocks is None:
        shard_bytes = docs.groupBy(F.coalesce(old_shard, F.lit(0)).alias("s")).agg(F.sum(_measures("text")[0]).alias("b"))
        most = shard_bytes.agg(F.max("b")).first()[0] or 0
        n_blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, most // BLOCK_BYTES))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *_measures("text"),
        F.coalesce(old_shard, F.lit(0)).cast("int").alias("old_shard"),
        *([F.struct(*map(quoted, docs.columns)).alias("row")] if whole else []),
    ).withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_blocks)).cast("int"))
    row = ["row"] if whole else []
    if not whole:
        slim = cut(slim)
    stats = slim.groupBy("old_shard", "block").agg(F.sum("size").alias("b")).orderBy("old_shard", "block").collect()
    supply = [0] * n_old
    start: list[tuple[int, int, int]] = []
    for r in stats:
        if not 0 <= r.old_shard < n_old:
            raise ValueError(f"old shard {r.old_shard} is not one of 0 to {n_old - 1}")
        start.append((r.old_shard, r.block, supply[r.old_shard]))
        supply[r.old_shard] += r.b
    if capacity is None:
        capacity = even_capacity(sum(supply), n_new)
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards cannot hold the old ones")
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(n_new)] for i in range(n_old)])
    cuts: dict[int, tuple[list[int], list[int]]] = {}
    for i in range(n_old):
        at, ends, to = 0, [], []
        for j in sorted(range(n_new), key=lambda j, i=i: (j != i, j)):
            if flow[i][j]:
                at += flow[i][j]
                ends.append(at)
                to.append(j)
        cuts[i] = (ends[:-1], to or [0])
    blocks = spark.createDataFrame(
        [(i, b, s, *cuts[i]) for i, b, s in start] or [(-1, -1, 0, [], [0])],
        "old_shard int, block int, start long, ends array<long>, dests array<int>",
    )
    w = Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size")
    offset = F.col("start") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    dealt = slim.join(F.broadcast(blocks), ["old_shard", "block"])
    if whole:  # the windows keep these ranges, so the placed files lie in the order of the slots
        dealt = dealt.repartitionByRange("old_shard", "block")
    placed = (
        dealt.select("*", offset.alias("at"), F.row_number().over(w).alias("rn"))
        .withColumn("shard", F.expr("dests[size(filter(ends, e -> e <= at))]"))
        .select("doc_id", "size", "text_crc32", "old_shard", "block", "shard", "rn", *row)
    )
    if whole:
        placed.write.parquet(whole)
        placed = spark.read.schema(placed.schema).parquet(whole)
    else:
        placed = cut(placed)
    pieces = (
        placed.groupBy("shard", "old_shard", "block")
        .agg(F.count("*").alias("n"), F.min("rn").alias("low"))
        .orderBy("shard", "old_shard", "block")
        .collect()
    )
    base: dict[int, int] = {}
    rows = []
    for r in pieces:
        rows.append((r.shard, r.old_shard, r.block, base.get(r.shard, 0) - r.low))
        base[r.shard] = base.get(r.shard, 0) + r.n
    lift = spark.createDataFrame(rows or [(-1, -1, -1, 0)], "shard int, old_shard int, block int, lift long")
    return placed.join(F.broadcast(lift), ["shard", "old_shard", "block"]).select(
        "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("lift") + F.col("rn")).alias("slot"), *row
    )


def affected(placed: DataFrame) -> list[int]:
    """New shards whose content differs from the old shard of that number."""
    moved = placed.filter("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    return sorted(r.s for r in moved.collect())


def reshard(
    docs: DataFrame,
    old_shard: Column,
    n_new: int,
    folder: str,
    capacity: list[int] | None = None,
    n_blocks: int | None = None,
    n_old: int | None = None,
) -> DataFrame:
    """Place the rows, write the affected shards under ``folder/shards/shard=N`` and read them back.

    The files hold ``row`` (all columns of ``docs``), ``old_shard`` and ``slot``, each sorted by slot; rows are
    shuffled once, by old shard and block.  ``folder`` must be new and seen by all executors.  Returns doc_id, size, text_crc32, old_shard, shard, slot: of affected shards
    from the written texts, of the others, which stay as they are, from their own."""
    spark, out = docs.sparkSession, f"{folder}/shards"
    placed = place(docs, old_shard, n_new, capacity, n_blocks, n_old, whole=f"{folder}/placed")
    held = placed.select("row", "old_shard", "slot", "shard")
    shards = affected(placed)
    rest = held.filter(~F.col("shard").isin(shards)) if shards else held
    if shards:
        (
            held.filter(F.col("shard").isin(shards))
            .sortWithinPartitions("shard", "slot")
            .write.partitionBy("shard")
            .parquet(out)
        )
        rest = spark.read.schema(held.schema).parquet(out).select(held.columns).unionByName(rest)
    return rest.withColumn("text", F.col("row")["text"]).select(
        F.col("row")["doc_id"].cast("long").alias("doc_id"), *_measures("text"), "old_shard", "shard", "slot"
    )
