"""Shards of equal row counts by balanced label propagation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import checkpointed, whole_text

#: Shares of moves that are let through at a time, and rounds of propagation at most.
STEPS, ROUNDS = 1024, 8

GROUP = ["size", "text_crc32", "digest"]


def balanced_shards(docs: DataFrame, shards: int = 8, rounds: int = ROUNDS, slack: float = 0.1) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `rows`: the shards' counts differ by one at most. size: UTF-8 bytes and 1; slot: place in the shard, gapless
    from 0; grown_shard is null. Documents are linked to those of equal text (null counts as empty). Everyone begins in a shard by
    hash; in each round linked documents ask for the shard that holds most of their group (ties by a hash), and as many move as quotas
    admit: swaps between two shards, and free places up to slack. At last unlinked documents fill the shards up evenly,
    linked ones only where those do not suffice.

    Linked documents of one group in one shard are alike, so the rounds work on one row a group, with its count in each shard;
    the documents are dealt to these counts once, at the end. Repeated rows have a slot each and are linked; a text of any length is
    read once, for its size and digests. An empty table gives no rows; other columns play no part.
    """
    rows = checkpointed(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(whole_text().cast("binary")).alias("text_crc32"),
        F.xxhash64(whole_text()).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumns({
        "begun": F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int"), "task": F.shiftright("row", 33).cast("int"),
    }))
    state = rows.groupBy(*GROUP).agg(F.array(*[F.count_if(F.col("begun") == s) for s in range(shards)]).alias("counts"))
    state = checkpointed(state.where(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n) > 1))
    begun, linked = shard_sums(rows.select(F.array(*[(F.col("begun") == s).cast("long") for s in range(shards)]).alias("counts")), shards), shard_sums(state, shards)
    alone = [a - b for a, b in zip(begun, linked)]
    room = int(sum(begun) / shards * (1 + slack)) + 1
    full: list[int] = []
    for turn in range(rounds):
        wishes = wish(state, turn, full)
        asked = [[[0] * STEPS for _ in range(shards)] for _ in range(shards)]
        asks = wishes.select(F.posexplode("counts").alias("shard", "n"), "wished", F.col("steps"))
        asks = asks.where("n > 0 and shard <> wished").withColumn("step", F.get("steps", F.col("shard")))
        table = asks.groupBy("shard", "wished", "step").agg(F.sum("n").alias("n")).collect()
        if not table:  # at most shards**2 * STEPS rows
            break
        for r in table:
            asked[r["shard"]][r["wished"]][r["step"]] = r["n"]
        sizes = [a + b for a, b in zip(alone, shard_sums(state, shards))]
        limits = admitted(asked, sizes, room)
        if not any(step or n for row in limits for step, n, _ in row):
            # nothing may move: once more, with the groups that are apart leaving the shards without room
            if full or not any(n >= room for n in sizes):
                break
            full = [s for s, n in enumerate(sizes) if n >= room]
            continue
        full = []
        state = checkpointed(moved(wishes, limits, shards))
    return levelled(dealt(rows, state), shards)


def shard_sums(rows: DataFrame, shards: int) -> list[int]:
    found = rows.agg(*[F.coalesce(F.sum(F.get("counts", F.lit(s))), F.lit(0)).alias(f"s{s}") for s in range(shards)]).first()
    return [int(n) for n in found]


def wish(state: DataFrame, turn: int, full: Sequence[int] = ()) -> DataFrame:
    """Groups with the shard where most of theirs are, and for each shard the step at which those there ask to move: small
    steps go first, those of larger gain ahead of the others. A group that is apart does not ask for a full shard."""
    apart = F.array_max("counts") < F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    known = lambda n, s: F.when(apart & s.isin(*full), F.lit(-1).cast("long")).otherwise(n) if full else n
    ranked = F.transform("counts", lambda n, s: F.struct(known(n, s).alias("n"), F.xxhash64(*GROUP, s).alias("tie"), s.alias("shard")))
    best = F.array_max(ranked)
    gain = F.least(F.floor(F.log2(F.greatest(F.col("best.n"), F.lit(1)) + 0.5)), F.lit(7)).cast("int")
    part = lambda s: F.pmod(F.xxhash64(*GROUP, s, F.lit(turn)), F.lit(STEPS // 8)).cast("int")
    steps = F.transform("counts", lambda n, s: (7 - gain) * (STEPS // 8) + part(s))
    return state.withColumn("best", best).select(*GROUP, "counts", F.col("best.shard").alias("wished"), steps.alias("steps"))


def admitted(asked, sizes: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """For each pair of shards (step, n, asked): what asks before `step` moves, and n of what asks at it."""
    shards = len(sizes)
    want = [[sum(asked[i][j]) for j in range(shards)] for i in range(shards)]
    quota = [[min(want[i][j], want[j][i]) for j in range(shards)] for i in range(shards)]
    free = [max(0, room - n) for n in sizes]
    for j in range(shards):
        rest = {i: want[i][j] - quota[i][j] for i in range(shards) if i != j}
        open_asks = sum(rest.values())
        for i, n in rest.items():
            if open_asks:
                quota[i][j] += min(n, free[j] * n // open_asks)
    limits = [[(0, 0, 1)] * shards for _ in range(shards)]
    for i in range(shards):
        for j in range(shards):
            done = 0
            for step, n in enumerate(asked[i][j]):
                if done + n > quota[i][j]:
                    if quota[i][j]:
                        limits[i][j] = (step, quota[i][j] - done, n)
                    break
                done += n
            else:
                limits[i][j] = (STEPS, done, 1)
    return limits


def moved(wishes: DataFrame, limits, shards: int) -> DataFrame:
    """Groups after the moves. At the last step of a pair, each gives its share of what is left, rounded down."""
    flat = [F.array(*[F.lit(limits[i][j][k]).cast("long") for i in range(shards) for j in range(shards)]) for k in range(3)]
    at = lambda k, s: F.get(flat[k], s * shards + F.col("wished"))
    step = lambda s: F.get("steps", s)
    part = lambda n, s: F.floor(n * (at(1, s) / at(2, s))).cast("long")
    going = F.transform("counts", lambda n, s: F.when((s == F.col("wished")) | (step(s) > at(0, s)), F.lit(0).cast("long")).when(step(s) < at(0, s), n).otherwise(part(n, s)))
    total = F.aggregate("going", F.lit(0).cast("long"), lambda a, n: a + n)
    after = F.transform("counts", lambda n, s: n - F.get("going", s) + F.when(s == F.col("wished"), F.col("total")).otherwise(0))
    return wishes.withColumn("going", going).withColumn("total", total).select(*GROUP, after.alias("counts"))


def dealt(rows: DataFrame, state: DataFrame) -> DataFrame:
    """rows with `shard` and `linked`: those of a group are numbered, and the numbers dealt to its counts.

    Numbers within a task of the first reading, and what lies in the tasks before: a group has one entry a task there, so
    a large one meets nowhere.
    """
    here = rows.groupBy("task", *GROUP).count()
    ahead = F.sum("count").over(Window.partitionBy(*GROUP).orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    places = here.withColumn("ahead", F.coalesce(ahead, F.lit(0))).drop("count").join(state, GROUP)
    local = F.row_number().over(Window.partitionBy("task", *GROUP).orderBy("row")) - 1
    met = rows.withColumn("local", local).join(places, ["task", *GROUP], "left").withColumn("number", F.col("local") + F.col("ahead"))
    upto = F.transform("counts", lambda n, s: F.aggregate(F.slice("counts", F.lit(1), s + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    shard = F.size(F.filter(upto, lambda n: n <= F.col("number")))
    return met.select("doc_id", "size", "text_crc32", "row", F.when(F.col("counts").isNull(), F.col("begun")).otherwise(shard).alias("shard"), F.when(F.col("counts").isNotNull(), 1).alias("linked"))


def levelled(rows: DataFrame, shards: int) -> DataFrame:
    """Rows numbered within their shards, unlinked ones first; what is above an equal share fills the others up.

    Numbers come from counts by (partition, shard): a few rows a partition meet on the driver.
    """
    spark = rows.sparkSession
    placed = checkpointed(rows.withColumn("fixed", F.col("linked").isNotNull().cast("int")).withColumn("part", F.spark_partition_id()))
    counts = placed.groupBy("part", "shard", "fixed").count().orderBy("shard", "fixed", "part").collect()
    sizes, offsets = [0] * shards, []
    for r in counts:
        offsets.append((r["part"], r["shard"], r["fixed"], sizes[r["shard"]]))
        sizes[r["shard"]] += r["count"]
    total = sum(sizes)
    order = sorted(range(shards), key=lambda s: -sizes[s])
    target = [total // shards] * shards
    for s in order[: total % shards]:
        target[s] += 1
    begin, given = 0, []
    for s in range(shards):
        surplus = max(0, sizes[s] - target[s])
        given.append((s, surplus, begin))
        begin += surplus
    taken, gaps = 0, []
    for s in range(shards):
        gap = max(0, target[s] - sizes[s])
        if gap:
            gaps.append((taken, taken + gap, s, sizes[s]))
        taken += gap
    table = spark.createDataFrame(offsets, "part int, shard int, fixed int, first long")
    local = Window.partitionBy("part", "shard", "fixed").orderBy("row")
    at = placed.withColumn("local", F.row_number().over(local) - 1).join(F.broadcast(table), ["part", "shard", "fixed"])
    at = at.withColumn("at", F.col("first") + F.col("local"))
    surplus, ahead = F.lit(0), F.lit(0)
    for s, n, b in given:
        surplus = F.when(F.col("shard") == s, n).otherwise(surplus)
        ahead = F.when(F.col("shard") == s, b).otherwise(ahead)
    at = at.withColumn("surplus", surplus.cast("long")).withColumn("out", F.when(F.col("at") < surplus, F.col("at") + ahead))
    shard, slot = F.col("shard"), F.col("at") - F.col("surplus")
    for low, high, s, size in gaps:
        here = (F.col("out") >= low) & (F.col("out") < high)
        shard = F.when(here, s).otherwise(shard)
        slot = F.when(here, F.col("out") - low + size).otherwise(slot)
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
