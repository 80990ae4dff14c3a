"""Items of varying length in containers of fixed capacity, by hierarchical multi-length packing.

Context sizes are the capacity, a half, a quarter and so on. An item is routed to the tier of the shortest
size that holds it. Inside a bucket, from the longest tier to the shortest:

* every tier is packed in windows of its own size; before it opens one, an item goes into the fullest
  window it fits, of its own or a longer tier, so that shorter tiers fill the gaps of long windows;
* windows, with what they hold, are then combined to containers, the fullest fit first;
* the shortest items were kept back to fill what is left, and the emptiest containers are taken apart
  again if their items fill the gaps of the others.

Containers are dealt to step groups of like cost over all buckets, by the sum of squared lengths.

Buckets are cut by a hash of key and text, about ``BUCKET_BYTES`` of text each; copies of a row are counted
first and dealt to buckets one by one, so no source, bitext, length or copied text can fill one, and
containers do not depend on how the input lies in files.

Defined results
---------------
* an item longer than the capacity is split: full parts in containers of their own, the rest is packed;
  no other item is split; items of size 0 (null and empty texts) take a place but no room;
* repeated rows are packed each; rows without key are packed too; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import RANKS, count_tokens
from tidemark.operators.places import numbered
from tidemark.session import cut_lineage

CAPACITY = 2048
BUCKET_BYTES = 6_000_000
BUCKET_ITEMS = 40_000
TIERS = 4
GROUP_CONTAINERS = 64
#: Items of this part of the shortest context size are kept back to fill what is left at the end.
FILLERS = 4


class Rooms:
    """Open bins by the room they have left; an item goes to the fullest one that it fits."""

    def __init__(self, most: int):
        self.of = [[] for _ in range(most + 1)]
        self.mask = 0  # bit r is set if some bin has r left
        self.used: list[int] = []

    def add(self, used: int, left: int) -> None:
        self.of[left].append(len(self.used))
        self.mask |= 1 << left
        self.used.append(used)

    def put(self, need: int, width: int) -> tuple[int, int]:
        """Bin and offset of an item; a new bin has the given width."""
        fits = self.mask >> need
        if not fits:
            self.add(0, width)
            fits, need_from = 1, width
        else:
            need_from = need + (fits & -fits).bit_length() - 1
        b = self.of[need_from].pop()
        if not self.of[need_from]:
            self.mask &= ~(1 << need_from)
        self.of[need_from - need].append(b)
        self.mask |= 1 << (need_from - need)
        self.used[b] += need
        return b, self.used[b] - need


def _descending(sizes: np.ndarray, items: np.ndarray) -> np.ndarray:
    return items[np.argsort(-sizes[items], kind="stable")]


def pack_tiers(sizes: np.ndarray, capacity: int, tiers: int = TIERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Container, offset and tier of each item no longer than the capacity."""
    widths = [capacity >> k for k in range(tiers)]
    tier = np.zeros(len(sizes), "int64")
    for k in range(1, tiers):
        tier[sizes <= widths[k]] = k
    kept_back = (tier == tiers - 1) & (sizes <= widths[-1] // FILLERS) if tiers > 1 else np.zeros(len(sizes), bool)
    windows, window, inside = Rooms(capacity), np.full(len(sizes), -1, "int64"), np.zeros(len(sizes), "int64")
    for k in range(tiers):
        for i in _descending(sizes, np.nonzero((tier == k) & ~kept_back)[0]):
            window[i], inside[i] = windows.put(int(sizes[i]), widths[k])
    used = np.array(windows.used, "int64")
    boxes, box, start = Rooms(capacity), np.zeros(len(used), "int64"), np.zeros(len(used), "int64")
    for w in _descending(used, np.arange(len(used))):
        box[w], start[w] = boxes.put(int(used[w]), capacity)
    container, offset = np.full(len(sizes), -1, "int64"), np.zeros(len(sizes), "int64")
    put = np.nonzero(~kept_back)[0]
    container[put], offset[put] = box[window[put]], start[window[put]] + inside[put]
    for i in _descending(sizes, np.nonzero(kept_back)[0]):
        container[i], offset[i] = boxes.put(int(sizes[i]), capacity)
    while True:
        again = _taken_apart(sizes, container, offset, capacity)
        if again is None:
            return container, offset, tier
        container, offset = again


def _taken_apart(sizes: np.ndarray, container: np.ndarray, offset: np.ndarray, capacity: int):
    """Container and offset with the items of the emptiest containers in the gaps of the others, if that saves a container."""
    n = int(container.max(initial=-1)) + 1
    used = np.bincount(container, weights=sizes, minlength=n).astype("int64")
    spare = (n * capacity - int(used.sum())) // capacity
    if spare < 1:
        return None
    order = np.argsort(used, kind="stable")
    gone = np.zeros(n, bool)
    gone[order[: min(n, 2 * spare)]] = True
    new = np.cumsum(~gone) - 1
    boxes = Rooms(capacity)
    for u in used[~gone]:
        boxes.add(int(u), capacity - int(u))
    container, offset = np.where(gone[container], -1, new[container]), offset.copy()
    for i in _descending(sizes, np.nonzero(container < 0)[0]):
        container[i], offset[i] = boxes.put(int(sizes[i]), capacity)
    return (container, offset) if len(boxes.used) < n else None


def deal_groups(containers: DataFrame, per_group: int = GROUP_CONTAINERS) -> DataFrame:
    """containers(container_id, cost) with their step_group, dealt to and fro over all of them by descending cost."""
    ranked = numbered(containers.withColumn("__less", -F.col("cost")), ["__less", "container_id"]).drop("__less")
    groups = F.lit(max(1, -(-containers.count() // per_group)))
    seat = F.col("place") % groups
    return ranked.withColumn("step_group", F.when(F.floor(F.col("place") / groups) % 2 == 0, seat).otherwise(groups - 1 - seat)).drop("place")


def pack_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ranks: str = RANKS, tiers: int = TIERS) -> DataFrame:
    """One row per part of a text: container_id, key, part_no, start_token, n_tokens, place, tier, step_group."""
    facts = documents.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    buckets = max(1, (facts["bytes"] or 0) // BUCKET_BYTES, facts["n"] // BUCKET_ITEMS)
    key_type = dict(documents.dtypes)[key]
    sized = documents.select(F.col(key).alias("k"), count_tokens(text, ranks).alias("size"), F.xxhash64(key, text).alias("h"))
    copies = sized.groupBy("k", "size", "h").agg(F.count("*").alias("copies"))
    rows = copies.select("k", "size", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"), "h")
    rows = rows.select("k", "size", F.xxhash64("h", "copy").alias("h"))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(int(buckets))))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h"], kind="stable")
        size, bucket = pdf["size"].to_numpy(), int(pdf["bucket"].iloc[0])
        full = size // capacity
        full -= (full > 0) & (size % capacity == 0)  # the last part of an exact multiple is an item like any other
        rest = size - full * capacity
        item = np.arange(len(size))
        container, offset, tier = pack_tiers(rest, capacity, tiers)
        extra = np.repeat(item, full)
        nth = np.arange(len(extra)) - np.repeat(np.cumsum(full) - full, full)
        made = int(container.max()) + 1
        at = np.concatenate([container, made + np.arange(len(extra))])
        who = np.concatenate([item, extra])
        part = np.concatenate([full, nth])
        return pd.DataFrame({
            "container_id": bucket * 2**32 + at, key: pdf["k"].to_numpy()[who], "part_no": part, "start_token": part * capacity,
            "n_tokens": np.concatenate([rest, np.full(len(extra), capacity)]), "place": np.concatenate([offset, np.zeros(len(extra), "int64")]),
            "tier": capacity >> np.concatenate([tier, np.zeros(len(extra), "int64")]),
        })

    longs = ", ".join(f"{c} long" for c in ("part_no", "start_token", "n_tokens", "place", "tier"))
    packed = cut_lineage(rows.groupBy("bucket").applyInPandas(pack, f"container_id long, {key} {key_type}, {longs}"))
    n = F.col("n_tokens")
    groups = deal_groups(packed.groupBy("container_id").agg(F.sum(n * n).alias("cost")))
    return packed.join(groups.select("container_id", "step_group"), "container_id")


def container_use(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """container_id, step_group, items, tokens used and left."""
    return packed.groupBy("container_id", "step_group").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("used")).withColumn(
        "unused", F.lit(capacity) - F.col("used")
    )
