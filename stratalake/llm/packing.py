"""Best-fit packing into sequences of several permitted lengths.

The lengths of all pieces are counted first; there are at most as many different ones as the largest
permitted sequence is long, so the counts are small whatever the number of documents. Best fit, longest
pieces first, is then run on counts: a piece goes where it leaves the least room, and bins alike in
content are handled as one group with a number. Where nothing fits, the permitted length of least cost
per token is opened: its cost over what it will hold, where the room left counts as far as shorter pieces
can fill it. At last each bin shrinks to the smallest permitted length that holds its content. Pieces get
their place by their rank among the pieces of equal length.

Cases: longer documents than the largest sequence are cut into full sequences and a rest; null, zero and
negative lengths take no room and get no bin; equal rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalake.llm.store import keep, whole

CAPACITIES = (512, 1024, 2048, 4096, 8192)
BUCKET_ROWS = 1 << 20


def token_cost(capacity: int) -> float:
    """What a sequence costs: its tokens, and 16 more for being a sequence."""
    return capacity + 16


def words_and_end(text: str) -> Column:
    """Words of the text column, runs of other characters than white space, and an end token; 1 if it is null or empty."""
    return F.size(F.array_remove(F.split(whole(text), r"\s+"), "")) + 1


class Group:
    """Bins alike: how many, the opened capacity, the room left, the content as (length, pieces in each bin)."""

    __slots__ = ("bins", "capacity", "room", "content")

    def __init__(self, bins: int, capacity: int, room: int, content: tuple):
        self.bins, self.capacity, self.room, self.content = bins, capacity, room, content

    def take(self, bins: int, length: int, each: int) -> "Group":
        self.bins -= bins
        return Group(bins, self.capacity, self.room - each * length, (*self.content, (length, each)))


def plan(counts: dict[int, int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = token_cost) -> list[Group]:
    """Groups of bins that hold `counts` pieces of each length, best fit, longest first."""
    rooms: list[int] = []
    at: dict[int, list[Group]] = {}
    shorter = sum(length * n for length, n in counts.items())

    def put(group: Group) -> None:
        if group.bins:
            if group.room not in at:
                at[group.room] = []
                insort(rooms, group.room)
            at[group.room].append(group)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        shorter -= length * left
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                size = min((c for c in capacities if c >= length), key=lambda c: (
                    cost(c) / (c // length * length + min(c % length, shorter * (c // length) / left)), -c))
                put(Group(-(-left // (size // length)), size, size, ()))
                continue
            room = rooms[k]
            group = at[room][-1]
            each = min(left, room // length)
            put(group.take(min(group.bins, left // each), length, each))
            filled = at[room][-1].bins if at[room][-1] is group else 0
            left -= each * (at[room - each * length][-1].bins)
            if not filled:
                at[room].remove(group)
                if not at[room]:
                    del at[room]
                    rooms.remove(room)
    groups = [g for room in rooms for g in at[room]]
    for g in groups:
        g.capacity = min(c for c in capacities if c >= g.capacity - g.room)
    return groups


def pieces(docs: DataFrame, length: str, largest: int, id_col: str = "doc_id") -> DataFrame:
    """id, piece, start, length: each document in sequences of at most `largest`."""
    n = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), n.alias("n"))
    return rows.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(n - 1, 0) div {largest}"))).alias("piece")).select(
        "id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest).cast("long"), F.col("n") - F.col("piece") * largest).alias("length"))


def best_fit(docs: DataFrame, length: str, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = token_cost,
             id_col: str = "doc_id", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """id, piece, start, length, bin, capacity, offset: where each piece of each document lies."""
    spark = docs.sparkSession
    capacities = sorted(capacities)
    cut = keep(pieces(docs, length, capacities[-1], id_col), "pieces")
    counts = dict(cut.where("length > 0").groupBy("length").count().collect())  # at most capacities[-1] rows
    slots, first, rank = [], 0, {}
    for g in plan(counts, capacities, cost):
        offset = 0
        for size, each in g.content:
            begin = rank.get(size, 0)
            rank[size] = begin + g.bins * each
            slots.append((size, begin, rank[size], first, each, offset, g.capacity))
            offset += size * each
        first += g.bins
    table = spark.createDataFrame(slots, "length long, begin long, end long, first long, each long, at long, capacity long")
    # ranks among equal lengths: a length with many pieces is dealt over buckets, numbered there, and shifted
    buckets = max(1, -(-sum(counts.values()) // bucket_rows))
    dealt = cut.where("length > 0").withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece")) - 1
    ranked = dealt.withColumn("number", number).join(before, ["length", "bucket"]).withColumn("rank", F.col("number") + F.col("before"))
    # the table is bounded by the largest capacity, not by the data
    placed = ranked.join(F.broadcast(table), "length").where("rank >= begin AND rank < end").withColumn("turn", F.col("rank") - F.col("begin"))
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", F.expr("first + turn div each").alias("bin"), "capacity",
        F.expr("at + (turn % each) * length").alias("offset")).unionByName(cut.where("length = 0").select(
            F.col("id").alias(id_col), "piece", "start", "length", F.lit(None).cast("long").alias("bin"),
            F.lit(None).cast("long").alias("capacity"), F.lit(None).cast("long").alias("offset")))
