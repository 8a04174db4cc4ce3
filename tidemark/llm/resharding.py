"""Resharding by minimum-cost flow: equal bytes in the new shards, fewest bytes moved."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shuffle_partitions

#: Rows that one block holds at most on average, and the least number of blocks for a large input;
#: the driver sees one row for each block.
BLOCK_ROWS, BLOCKS = 1 << 20, 512
#: Rows of a rewritten file.
FILE_ROWS = 1 << 16
_INF = 1 << 62


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one: all supply is placed, fewest bytes change shard.

    A byte that stays under its shard's number costs nothing, any other costs one. Successive
    shortest augmenting paths on source -> old -> new -> sink; needs sum(capacity) >= sum(supply).
    """
    if sum(capacity.values()) < sum(supply.values()):
        raise ValueError("the new shards can't hold all bytes")
    graph: dict[tuple, dict[tuple, list[int]]] = {}

    def arc(a: tuple, b: tuple, room: int, cost: int) -> None:
        graph.setdefault(a, {})[b] = [room, cost]
        graph.setdefault(b, {})[a] = [0, -cost]

    source, sink = ("source",), ("sink",)
    graph[source], graph[sink] = {}, {}
    for i, s in supply.items():
        arc(source, ("old", i), s, 0)
        for j in capacity:
            arc(("old", i), ("new", j), _INF, int(i != j))
    for j, c in capacity.items():
        arc(("new", j), sink, c, 0)
    while True:
        cost, back, queue = {source: 0}, {}, deque([source])
        while queue:
            a = queue.popleft()
            for b, (room, c) in graph[a].items():
                if room > 0 and cost[a] + c < cost.get(b, _INF):
                    cost[b], back[b] = cost[a] + c, a
                    queue.append(b)
        if sink not in cost:
            break
        path, node = [], sink
        while node != source:
            path.append((back[node], node))
            node = back[node]
        amount = min(graph[a][b][0] for a, b in path)
        for a, b in path:
            graph[a][b][0] -= amount
            graph[b][a][0] += amount
    return {(i, j): graph[("new", j)][("old", i)][0] for i in supply for j in capacity if graph[("new", j)][("old", i)][0]}


def _ranges(flow: dict[tuple[int, int], int]) -> dict[int, list[tuple[int, int]]]:
    """For each old shard, (end, new shard) of consecutive byte ranges: what stays comes first."""
    out: dict[int, list[tuple[int, int]]] = {}
    for i in {i for i, _ in flow}:
        end = 0
        out[i] = []
        for j, amount in sorted(((j, a) for (o, j), a in flow.items() if o == i), key=lambda x: (x[0] != i, x[0])):
            end += amount
            out[i].append((end, j))
    return out


#: Groups of equal texts that may be placed by the driver one by one: those over a thousandth of a
#: shard's bytes or rows, which are two thousand for each shard at most.
LARGE = 1000
#: A shard may go over its even share by a fiftieth to keep a large group whole.
SLACK = 50


def _place_large(large: list[tuple], capacity: dict[int, int]) -> tuple[dict[tuple, int], list[tuple]]:
    """Shards of (key, bytes, home) groups, largest first: home if it has room, else where most is.

    Takes their bytes off ``capacity``. Groups that no shard has room for come back as the second.
    """
    placed, split = {}, []
    slack = sum(capacity.values()) // (len(capacity) * SLACK)
    for key, size, home in sorted(large, key=lambda g: (-g[1], g[0])):
        roomiest = max(capacity, key=lambda j: (capacity[j], -j))
        at = home if capacity.get(home, -1) >= size else roomiest
        if capacity[at] + slack >= size:
            placed[key] = at
            capacity[at] -= size
        else:
            split.append(key)
    for j in capacity:
        capacity[j] = max(0, capacity[j])
    return placed, split


def reshard(docs: DataFrame, old_shard: Column, shards: int, payload: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Place every row in one of ``shards`` new shards of near-equal bytes, equal texts together.

    ``old_shard`` gives the shard (0 or more) that holds a row now; null counts as shard 0.
    Returns ``doc_id, size, text_crc32, old_shard, shard, slot, moved`` and the payload columns.
    ``size`` is the UTF-8 bytes of the text (null: none) plus one. Slots of a shard run from 0
    without gaps. Rows of equal texts (null is the empty text) go to one shard, unless no shard has
    room for the group: then its rows are placed one by one. Shards differ by the bytes of a group
    of a thousandth of a shard at most. Repeated rows and equal doc_ids are rows like any other; an
    empty table gives an empty table.

    A group counts for the old shard that holds most of its rows. The driver sees large groups (a
    bounded number, see LARGE) and sums of blocks (old shard, size class, hash of the text or, in a
    group that is split, of the row); the flow gives the bytes that go from each old shard to each
    new one, and within a block a window of running bytes tells where a unit's middle falls.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        "doc_id",
        *payload,
        (F.octet_length(whole).cast("long") + 1).alias("size"),
        F.crc32(whole).alias("text_crc32"),
        F.coalesce(old_shard, F.lit(0)).cast("int").alias("old_shard"),
        F.xxhash64(whole).alias("h1"),
        F.xxhash64(F.lit(1), whole).alias("h2"),
    )
    base = cut(base.withColumn("row", F.monotonically_increasing_id()))
    key = ["h1", "h2"]
    held = base.groupBy(*key, "old_shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    home = F.max_by("old_shard", F.struct("n", -F.col("old_shard"))).alias("old_shard")
    groups = cut(held.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), home))
    rows, total = (int(x or 0) for x in groups.agg(F.sum("n"), F.sum("bytes")).first())
    capacity = {j: total // shards + (j < total % shards) for j in range(shards)}
    over = (F.col("bytes") > total // (shards * LARGE)) | (F.col("n") > rows // (shards * LARGE))
    # Each of these holds a part of all rows or bytes that has a fixed least size.
    large = [((r["h1"], r["h2"]), r["bytes"], r["old_shard"]) for r in groups.where(over).collect()]
    placed, split = _place_large(large, capacity)
    named = F.broadcast(spark.createDataFrame([(*k, placed.get(k)) for k, _, _ in large], "h1 long, h2 long, at int"))
    told = base.join(named.withColumn("large", F.lit(True)), key, "left")
    single = told.where("large and at is null").drop("large", "at", "h1", "h2")
    units = groups.where(~over).select(F.lit(False).alias("alone"), "h1", "h2", "bytes", "old_shard")
    if split:
        units = units.unionByName(single.select(F.lit(True).alias("alone"), F.col("row").alias("h1"), F.lit(0).cast("long").alias("h2"), F.col("size").alias("bytes"), "old_shard"))
    units = units.withColumn("size_class", (F.lit(40) - F.floor(F.log2("bytes"))).cast("int"))
    target = max(1, min(BLOCK_ROWS, rows // BLOCKS))
    kinds = units.groupBy("old_shard", "size_class").agg(F.count(F.lit(1)).alias("n")).collect()
    # A row for each old shard and size class, so this is small whatever the number of documents.
    subs = F.broadcast(spark.createDataFrame([(r["old_shard"], r["size_class"], -(-r["n"] // target)) for r in kinds], "old_shard int, size_class int, parts int"))
    units = units.join(subs, ["old_shard", "size_class"]).withColumn("sub", F.pmod(F.xxhash64("h1", "h2"), F.col("parts")).cast("int")).drop("parts")
    block = ["old_shard", "size_class", "sub"]
    sums = sorted(map(tuple, units.groupBy(*block).agg(F.sum("bytes")).collect()))
    supply: dict[int, int] = {}
    for o, _, _, s in sums:
        supply[o] = supply.get(o, 0) + s
    ranges = _ranges(min_cost_flow(supply, capacity))
    plan, at = [], dict.fromkeys(supply, 0)
    for o, c, u, s in sums:
        begin, at[o] = at[o], at[o] + s
        ends = [(e, j) for e, j in ranges[o] if e > begin]
        cuts = [e - begin for e, _ in ends if e < at[o]]
        plan.append((o, c, u, cuts, [j for _, j in ends[: len(cuts) + 1]]))
    blocks = spark.createDataFrame(plan, "old_shard int, size_class int, sub int, cuts array<long>, targets array<int>")
    order = Window.partitionBy(*block).orderBy(F.col("bytes").desc(), "alone", "h1", "h2")
    middle = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.floor(F.col("bytes") / 2)
    assigned = units.withColumn("middle", middle).join(F.broadcast(blocks), block)
    # A unit at a block's end may lie past its last cut by rounding only, so targets are never missed.
    assigned = assigned.select("alone", "h1", "h2", F.get("targets", F.size(F.filter("cuts", lambda c: c < F.col("middle")))).alias("shard"))
    out = ["row", "doc_id", *payload, "size", "text_crc32", "old_shard", "shard"]
    found = told.where("at is not null").withColumn("shard", F.col("at")).select(*out)
    found = found.unionByName(told.where("large is null").join(assigned.where("not alone").drop("alone"), key).select(*out))
    if split:
        found = found.unionByName(single.join(assigned.where("alone").select(F.col("h1").alias("row"), "shard"), "row").select(*out))
    # Numbers of rows are distinct, so blocks of a shard by their hash are even, whatever repeats.
    numbering = Window.partitionBy("shard", "sub").orderBy("doc_id", "row")
    found = found.withColumn("sub", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-rows // target)))).cast("int"))
    found = cut(found.withColumn("rn", F.row_number().over(numbering).cast("long")))
    offsets, filled = [], {}
    for s, u, n in sorted(map(tuple, found.groupBy("shard", "sub").agg(F.max("rn")).collect())):
        offsets.append((s, u, filled.get(s, 0) - 1))
        filled[s] = filled.get(s, 0) + n
    shift = F.broadcast(spark.createDataFrame(offsets, "shard int, sub int, shift long"))
    return found.join(shift, ["shard", "sub"]).select(
        "doc_id", *payload, "size", "text_crc32", "old_shard", "shard", (F.col("rn") + F.col("shift")).alias("slot"), (F.col("old_shard") != F.col("shard")).alias("moved")
    )


def write_affected(placed: DataFrame, path: str) -> list[int]:
    """Rewrite, as ``path/shard=N``, the shards that gained or lost rows; returns their numbers.

    Rows are sorted by slot in each file. Shards that keep exactly their rows aren't touched.
    """
    moved = placed.where("moved").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    touched = sorted(r["s"] for r in moved.collect())
    affected = placed.where(F.col("shard").isin(touched))
    (
        affected.repartition(shuffle_partitions(placed.sparkSession), "shard", F.floor(F.col("slot") / FILE_ROWS))
        .sortWithinPartitions("shard", "slot")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard")
        .parquet(path)
    )
    return touched


def rewritten(placed: DataFrame, path: str) -> DataFrame:
    """The rows of all shards after the affected ones were written under ``path`` and read again."""
    touched = write_affected(placed, path)
    same = placed.where(~F.col("shard").isin(touched))
    if not touched:
        return same
    return placed.sparkSession.read.schema(placed.schema).parquet(path).select(*placed.columns).unionByName(same)
