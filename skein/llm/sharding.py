"""Sharding through fixed virtual slots.

Each record hashes into one of ``N_SLOTS`` virtual slots by its text, so that equal texts keep together. Only a group
of equal texts that is larger than a shard can take up beside others is dealt by doc_id too; the map names these few
groups. Bytes are summed by slot, and a small versioned map says which shard owns a slot. Rebalancing edits the map, so
that only the slots it names move. The map has as many entries as there are slots, whatever the data's size; no data
row reaches the driver.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import read, scratch, table

N_SLOTS = 4096
#: A group of equal texts with more than this share of a shard's bytes is split.
SPLIT_SHARE = 0.5
#: Rows that are numbered together; a slot with more is numbered in several places, but for very large tables in 64 at most
#: where slots are equal, so that places stay few.
PLACE_ROWS, PLACES = 500, 64
#: Places up to this number are broadcast (about 70 bytes each), more are joined by a shuffle.
FEW = 400_000


@dataclass
class SlotMap:
    """Owner of every slot at a version; ``moved`` has the slots that the last edit gave to another shard, ``split`` the
    hashes of texts whose copies are dealt by doc_id (fixed with the first version)."""

    n_shards: int
    owner: list[int]
    version: int = 1
    moved: list[int] = field(default_factory=list)
    split: list[int] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def from_json(text: str) -> SlotMap:
        return SlotMap(**json.loads(text))


def save_map(spark: SparkSession, m: SlotMap, path: str) -> None:
    """Add a version to the stored map (a version is never overwritten)."""
    spark.sql("SELECT :v AS version, :m AS slot_map", {"v": m.version, "m": m.to_json()}).write.mode("errorifexists").json(f"{path}/version={m.version:08d}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The map of a version, the newest if none is named."""
    df = spark.read.schema("slot_map STRING, version INT").json(path)
    df = df.filter(F.col("version") == version) if version else df.orderBy(F.desc("version"))
    return SlotMap.from_json(df.select("slot_map").limit(1).collect()[0][0])


def plan_map(slot_bytes: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """Largest slot first, each to the shard that is least full; slots without rows are dealt round robin."""
    owner, load = [s % n_shards for s in range(n_slots)], [(0, k) for k in range(n_shards)]
    for slot, size in sorted(slot_bytes.items(), key=lambda x: (-x[1], x[0])):
        full, shard = heapq.heappop(load)
        owner[slot] = shard
        heapq.heappush(load, (full + size, shard))
    return SlotMap(n_shards, owner)


def rebalance(m: SlotMap, slot_bytes: dict[int, int], n_shards: int | None = None) -> SlotMap:
    """The next version: slots move one by one from the fullest shard to the emptiest while that narrows the gap."""
    n, owner, load = n_shards or m.n_shards, list(m.owner), {}
    held: dict[int, list[tuple[int, int]]] = {k: [] for k in range(n)}
    spare = []
    for slot, shard in enumerate(owner):
        size = slot_bytes.get(slot, 0)
        (held[shard] if shard < n else spare).append((size, slot))
    load = {k: sum(x[0] for x in v) for k, v in held.items()}
    moved = set()

    def give(size: int, slot: int, to: int) -> None:
        owner[slot] = to
        held[to].append((size, slot))
        load[to] += size
        moved.add(slot)

    for size, slot in sorted(spare, reverse=True):  # of shards that are gone
        give(size, slot, min(load, key=lambda k: (load[k], k)))
    while True:
        top, low = max(load, key=lambda k: (load[k], -k)), min(load, key=lambda k: (load[k], k))
        gap = load[top] - load[low]
        fits = [x for x in held[top] if 0 < x[0] < gap]
        if not fits:
            break
        pick = min(fits, key=lambda x: (abs(gap / 2 - x[0]), x[1]))
        held[top].remove(pick)
        load[top] -= pick[0]
        give(*pick, low)
    return SlotMap(n, owner, m.version + 1, sorted(moved), list(m.split))


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, size (UTF-8 bytes plus 1), text_crc32 and text_hash, which equal texts have in common."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return df.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("text_hash"))


def crowded(rows: DataFrame, n_shards: int) -> list[int]:
    """Hashes of the texts whose copies have more than SPLIT_SHARE of a shard's bytes: at most n_shards / SPLIT_SHARE."""
    total = rows.agg(F.sum("size")).collect()[0][0] or 0
    groups = rows.groupBy("text_hash").agg(F.sum("size").alias("n"), F.count("*").alias("copies"))
    return sorted(r[0] for r in groups.filter((F.col("n") > SPLIT_SHARE * total / n_shards) & (F.col("copies") > 1)).select("text_hash").collect())


def with_slots(rows: DataFrame, split: list[int], n_slots: int = N_SLOTS) -> DataFrame:
    """The sized rows with their vslot, which depends on a row's text, and on doc_id where its copies are split."""
    alone = F.col("text_hash").isin(*split) if split else F.lit(False)
    return rows.withColumn("vslot", F.pmod(F.xxhash64("text_hash", F.when(alone, F.col("doc_id"))), F.lit(n_slots)).cast("int"))


def slot_totals(slotted: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Bytes and rows by slot: at most one row a slot comes to the driver."""
    rows = slotted.groupBy("vslot").agg(F.sum("size"), F.count("*")).collect()
    return {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}


def _lookup(values: list[int], key: str, kind: str):
    """values[key] as a folded literal array."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), F.col(key) + 1)


def assign(df: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, slot_map: SlotMap | None = None, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Deal rows to shards of near equal bytes. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot.

    slot is the row's number in its shard, gapless from 0: the rows in the shard's earlier virtual slots and in earlier
    places of its own slot, plus the row's rank in its place, so that no task ever sorts a whole shard or a large slot. A given slot_map is used as it is; else a map is planned, stored
    under map_path (a new folder of the shared one if none is named) as its version 1, and used as read back from there.
    Equal texts share a shard, but for those that the map splits.
    Null text counts as empty (size 1); null ids, repeated rows and ties get places like any other row (among equal
    rows in no set order); an empty table gives an empty result; further columns are ignored.
    """
    rows = table(sized(df, id_col, text_col), "sizes")
    m = slot_map
    split = crowded(rows, n_shards) if m is None else m.split
    rows = with_slots(rows, split, n_slots)
    size, count = slot_totals(rows)
    if m is None:
        path = map_path or scratch(df.sparkSession, "slot_map")
        planned = plan_map(size, n_shards, n_slots)
        planned.split = split
        save_map(df.sparkSession, planned, path)
        m = load_map(df.sparkSession, path)
    first, base = [0] * n_slots, [0] * m.n_shards
    for s in range(n_slots):
        first[s] = base[m.owner[s]]
        base[m.owner[s]] += count.get(s, 0)
    most = max(PLACE_ROWS, sum(count.values()) // (PLACES * n_slots))
    places = [max(1, -(-count.get(s, 0) // most)) for s in range(n_slots)]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("place")), _lookup(places, "vslot", "int")))
    before = F.sum("n").over(Window.partitionBy("vslot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("vslot", "part").agg(F.count("*").alias("n")).select("vslot", "part", F.coalesce(before, F.lit(0)).alias("before"))
    rows = rows.join(F.broadcast(offsets) if sum(places) <= FEW else offsets, ["vslot", "part"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32")) - 1
    return rows.withColumn("place", place).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), _lookup(m.owner, "vslot", "int").alias("shard"), (_lookup(first, "vslot", "bigint") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents"))
