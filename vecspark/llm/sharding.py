"""Sharding by fixed virtual slots: records hash into slots, slots map to shards, the map is versioned and edited.

A record's slot is a hash of its doc_id, the checksum and the size of its text, so it never changes with the data
around it.  Bytes and rows are aggregated per slot.  The map (slot, shard, spread) starts as even runs of slots and is
then *edited*: overfull shards give up slots, underfull ones take them, until no single slot can be moved from the
fullest to the emptiest shard with gain.  Every edit is stored as a new version beside the old ones; a reader names
the version it wants or takes the last.  ``add_shard`` is an edit as well: every shard hands slots to the new one only.

A slot of several rows with more than 1/SPREAD of a shard's mean may be one record repeated many times, which no map can
balance.  Such slots (at most SPREAD times the shards) are marked ``spread`` in the map: their rows are dealt over all
slots by the row's own number.

How it scales: texts are read once and never shuffled; what is stored and shuffled is (doc_id, size, checksum).  The slot
table has at most SLOTS rows at any size; it alone is edited on the driver and broadcast.  Positions in a shard are
numbered within (slot, part of a slot), where the parts grow in number with the rows, on top of running counts.

Edge cases: a null text has size 16 and checksum 0; a null doc_id is a value like another; very long texts count with
all their bytes and can make a shard larger than the mean by that one record; slots of equal size move in order of their
number; equal texts, equal ids and repeated rows
are records of their own; an empty table gives no rows and an even map; other columns are not read, whatever their
names (``write_shards`` keeps them).
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.llm import common

SLOTS = 8192
SPREAD = 8                     # a slot of more than this part of a shard is dealt anew by row
OVERHEAD = 16                  # bytes that a record takes besides its text
PART_ROWS = 1 << 16            # rows of one numbering window, on average
MAP = "slot int, shard int, spread boolean"


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + F.lit(OVERHEAD)).cast("long")


def checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")))


def key_of(doc_id: Column, size: Column, crc: Column) -> Column:
    return F.xxhash64(doc_id, size, crc)


def slot_of(key: Column, spread: Column, row: Column) -> Column:
    """The slot of a record: by its own key, or where its slot is spread by key and row number."""
    own = F.pmod(key, F.lit(SLOTS))
    return F.when(spread, F.pmod(F.xxhash64(key, row), F.lit(SLOTS))).otherwise(own).cast("int")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key, row): one row a record, without its text."""
    text = F.col("text")
    rows = docs.select("doc_id", size_of(text).alias("size"), checksum(text).alias("text_crc32"))
    return rows.select("*", key_of(F.col("doc_id"), F.col("size"), F.col("text_crc32")).alias("key"),
                       F.monotonically_increasing_id().alias("row"))


def slot_table(rows: DataFrame, spread: DataFrame | None = None) -> DataFrame:
    """(slot, bytes, n): what each slot holds; ``spread`` is (slot) of the slots that are dealt by row."""
    if spread is None:
        slot = F.pmod("key", F.lit(SLOTS)).cast("int")
    else:
        rows = marked(rows, spread)
        slot = slot_of(F.col("key"), F.col("spread"), F.col("row"))
    return rows.groupBy(slot.alias("slot")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def marked(rows: DataFrame, spread: DataFrame) -> DataFrame:
    """``rows`` with ``spread``: whether the record's own slot is dealt by row (``spread`` has at most SLOTS rows)."""
    own = spread.select(F.col("slot").alias("__own"), F.lit(True).alias("spread"))
    return (rows.join(F.broadcast(own), F.pmod(rows["key"], F.lit(SLOTS)) == F.col("__own"), "left").drop("__own")
            .withColumn("spread", F.coalesce("spread", F.lit(False))))


def even_map(shards: int) -> dict[int, int]:
    """The first version: even runs of slots."""
    return {s: s * shards // SLOTS for s in range(SLOTS)}


def rebalance(shard_of: dict[int, int], size: dict[int, int], shards: int) -> dict[int, int]:
    """Edit the map until no slot can go from the fullest to the emptiest shard with gain.

    First every shard above the mean gives up slots, largest first, that fit its excess; those go, largest first, to
    the emptiest shard.  Then single slots are moved from the fullest to the emptiest shard.  All on SLOTS rows.
    """
    new = dict(shard_of)
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot in sorted(size, key=lambda s: (-size[s], s)):
        load[new[slot]] += size[slot]
        held[new[slot]].append(slot)
    mean = sum(load) / shards
    pool = []
    for shard in range(shards):
        for slot in held[shard]:
            if 0 < size[slot] <= load[shard] - mean:
                pool.append(slot)
                load[shard] -= size[slot]
    queue = [(load[s], s) for s in range(shards)]
    heapq.heapify(queue)
    for slot in sorted(pool, key=lambda s: (-size[s], s)):
        least, shard = heapq.heappop(queue)
        new[slot] = shard
        heapq.heappush(queue, (least + size[slot], shard))
    slots: list[set[int]] = [set() for _ in range(shards)]
    load = [0] * shards
    for slot, b in size.items():
        load[new[slot]] += b
        slots[new[slot]].add(slot)
    while True:
        top, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[top] - load[low]
        fits = [s for s in slots[top] if 0 < size[s] < gap]
        if not fits:
            return new
        slot = min(fits, key=lambda s: (abs(2 * size[s] - gap), s))
        slots[top].remove(slot)
        slots[low].add(slot)
        load[top] -= size[slot]
        load[low] += size[slot]
        new[slot] = low


def add_shard(shard_of: dict[int, int], size: dict[int, int], shards: int) -> dict[int, int]:
    """Edit for one more shard (number ``shards``): slots move only into it, from the fullest shards, up to the mean."""
    new = dict(shard_of)
    held: list[list[int]] = [[] for _ in range(shards)]
    load = [0] * shards
    for slot in sorted(size, key=lambda s: (size[s], s)):
        held[new[slot]].append(slot)
        load[new[slot]] += size[slot]
    goal, taken = sum(load) / (shards + 1), 0
    queue = [(-load[s], s) for s in range(shards) if held[s]]
    heapq.heapify(queue)
    while queue and taken < goal:
        full, shard = heapq.heappop(queue)
        fits = [i for i, s in enumerate(held[shard]) if taken + size[s] <= goal]
        if not fits:
            continue
        slot = held[shard].pop(fits[-1])
        new[slot] = shards
        taken += size[slot]
        if held[shard]:
            heapq.heappush(queue, (full + size[slot], shard))
    return new


def save_map(spark: SparkSession, root: str, shard_of: dict[int, int], spread: set[int], version: int) -> None:
    """Store a version of the map as one file (it is there as a whole or not at all); versions are never overwritten."""
    rows = [(slot, shard, slot in spread) for slot, shard in sorted(shard_of.items())]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("errorifexists").parquet(f"{root}/version={version}")


def load_map(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(slot, shard, spread, version) of one version, by default the last."""
    kept = spark.read.schema(MAP + ", version int").parquet(root)
    if version is None:
        version = kept.agg(F.max("version")).first()[0]
    return kept.filter(F.col("version") == F.lit(version))


def fit_map(rows: DataFrame, root: str, shards: int, version: int = 0) -> int:
    """Version ``version`` of the map under ``root`` (even runs) and its edit by the bytes of ``rows``; the last number."""
    spark = rows.sparkSession
    held = slot_table(rows).collect()                                                     # at most SLOTS rows
    size = {r["slot"]: r["bytes"] for r in held}
    total = sum(size.values())
    spread = {r["slot"] for r in held if r["n"] > 1 and r["bytes"] * shards * SPREAD > total}
    save_map(spark, root, even_map(shards), spread, version)
    if spread:
        hot = spark.createDataFrame([(s,) for s in sorted(spread)], "slot int")
        size = {r["slot"]: r["bytes"] for r in slot_table(rows, hot).collect()}
    save_map(spark, root, rebalance(even_map(shards), size, shards), spread, version + 1)
    return version + 1


def placed(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """``rows`` of ``sized`` with ``slot`` and ``shard`` by a stored map (SLOTS rows, broadcast twice)."""
    found = marked(rows, slots.filter("spread").select("slot")).withColumn(
        "slot", slot_of(F.col("key"), F.col("spread"), F.col("row")))
    return found.join(F.broadcast(slots.select("slot", "shard", "version")), "slot")


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, position, version): every record's place; positions of a shard run from 0."""
    spark = docs.sparkSession
    rows = common.stored(sized(docs), "sized")
    root = common.scratch(spark, "slot-map")
    slots = load_map(spark, root, fit_map(rows, root, shards))
    parts = 1 + (rows.count() // (SLOTS * PART_ROWS))
    found = (placed(rows, slots).withColumn("part", F.pmod(F.xxhash64("key", "row", F.lit(1)), F.lit(parts)))
             .select("doc_id", "size", "text_crc32", "shard", "slot", "part", "row", "version"))
    counts = found.groupBy("shard", "slot", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("slot", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("slot", "part").orderBy("doc_id", "text_crc32", "row")
    numbered = found.withColumn("inner", F.row_number().over(within)).join(base, ["slot", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", "slot",
                           (F.col("base") + F.col("inner") - 1).cast("long").alias("position"), "version")


def write_shards(docs: DataFrame, root: str, path: str, version: int | None = None) -> None:
    """Write whole rows as Parquet under ``path/__shard=<shard>`` by a stored map; all columns of ``docs`` are kept."""
    slots = load_map(docs.sparkSession, root, version)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")
    key = key_of(F.col("doc_id"), size_of(F.col("text")), checksum(F.col("text")))
    held = placed(docs.select(row, key.alias("key"), F.monotonically_increasing_id().alias("row")), slots)
    spot = F.concat_ws("/", "shard", "slot")
    (held.select("record.*", F.col("shard").alias("__shard"), spot.alias("__spot"))
     .repartition("__shard", "__spot").drop("__spot").write.partitionBy("__shard").parquet(path))
