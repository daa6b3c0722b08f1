"""Documents into containers of fixed capacity, planned on a histogram of lengths.

Best fit, longest first, runs over counts of equal lengths: a step places as
many items of one length as fit into a whole range of equally filled
containers. The plan says for each length which ranks take which slots, and
the documents find their slots by joining on their rank within the length.
Only the histogram, of at most ``capacity`` rows, ever reaches the driver.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.tokenizer import token_count
from lathe.session import bounded_broadcast, cut, ranked_within

#: Slices by which the items of one length are ranked; a third of all items in one length is still 256 tasks' work.
SLICES = 256


def plan_slots(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit decreasing over counts.

    ``histogram`` maps a length (1 to ``capacity``) to its number of items.
    Returns (slots, containers). A slot row (length, first_rank, last_rank,
    each, container, start) says: items of that length with these ranks (from
    0) fill the containers from ``container`` on, ``each`` to a container, one
    after another from offset ``start``.
    """
    # room -> heap of (first container, number) with exactly that room left
    open_: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    slots, containers = [], 0

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            heapq.heappush(open_[room], (first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, number = heapq.heappop(open_[room])
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
            else:
                room, first = capacity, containers
                number = -(-left // (capacity // length))
                containers += number
            each = room // length
            full = min(number, left // each)
            if full:
                slots.append((length, rank, rank + full * each - 1, each, first, capacity - room))
                put(room - each * length, first, full)
                rank += full * each
                left -= full * each
            if full < number:
                rest = left  # fewer than fill one container
                if rest and rest < each:
                    slots.append((length, rank, rank + rest - 1, each, first + full, capacity - room))
                    put(room - rest * length, first + full, 1)
                    rank, left, full = rank + rest, 0, full + 1
                put(room, first + full, number - full)
    return slots, containers


def pack(items: DataFrame, capacity: int = 2048, key: str = "doc_id", size: str = "size") -> DataFrame:
    """(container_id, key, piece, start, length, offset) of every item.

    ``offset`` is the place in the container, ``start`` the place in the item.
    An item is split only if it is larger than ``capacity``: into full pieces,
    numbered from 0, and one rest. Items of size 0, null or below take no room
    and go to container 0. Items of one length take its slots in the order of
    a hash of the key; which of rows with the same key takes which slot is open.
    """
    sized = cut(items.select(F.col(key).alias("__key"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("__size")))
    pieces = sized.where("__size > 0").select(
        "__key", "__size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__size - 1) div {capacity}"))).alias("piece")
    )
    pieces = pieces.withColumn("start", F.col("piece") * capacity).withColumn("length", F.least(F.col("__size") - F.col("start"), F.lit(capacity)))
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    slots, _ = plan_slots({r.length: r.n for r in counts}, capacity)
    spark = items.sparkSession
    plan = spark.createDataFrame(slots, "length long, first_rank long, last_rank long, each long, container long, at long")
    # The slice follows the order by which equal lengths are ranked: a hash first, then the key.
    ordered = pieces.withColumn("__h", F.xxhash64("__key", "piece"))
    slice_by = F.expr(f"cast(floor((__h / 18446744073709551616.0D + 0.5D) * {SLICES}) as int)")
    ranked = ranked_within(ordered, ["length"], ["__h", "__key", "piece"], slice_by, "rank")
    ranked = ranked.withColumn("rank", F.col("rank") - 1)
    on = (F.col("i.length") == F.col("p.length")) & F.col("i.rank").between(F.col("p.first_rank"), F.col("p.last_rank"))
    placed = ranked.alias("i").join(bounded_broadcast(plan).alias("p"), on)
    within = F.col("rank") - F.col("first_rank")
    placed = placed.select(
        (F.col("container") + F.floor(within / F.col("each"))).cast("long").alias("container_id"), F.col("__key").alias(key),
        "piece", "start", "i.length", (F.col("at") + within % F.col("each") * F.col("i.length")).alias("offset"),
    )
    zero = F.lit(0).cast("long")
    nothing = sized.where("__size = 0").select(zero.alias("container_id"), F.col("__key").alias(key), *[zero.alias(c) for c in ("piece", "start", "length", "offset")])
    return placed.unionByName(nothing)


def pack_documents(documents: DataFrame, capacity: int = 2048, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Containers of documents by their number of ids; see ``pack``."""
    return pack(documents.select("doc_id", token_count(F.col("text"), name, folder).alias("size")), capacity)
