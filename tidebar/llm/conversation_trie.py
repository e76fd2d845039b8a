"""Prefix trie of conversations, built as a burst trie."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import checkpointed, shuffle_partitions

#: Turns that a container holds before it bursts, and turns of one conversation that lie in one row.
CAPACITY, BLOCK_TURNS = 4096, 512
#: A trie head with this share of all rows is looked up by broadcast; there are at most 1 / HOT_SHARE.
HOT_SHARE = 1 / 1000
#: Bytes of ids that are hashed as one piece, and rows of suffixes that are read at a time in a task.
PIECE, READ_ROWS = 1 << 16, 256

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv, turn, key, words: key stands for (role, text), 128 bits of SHA-256."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        F.unhex(F.substring(F.sha2(both.cast("binary"), 256), 1, 32)).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def numbered(turns: DataFrame) -> DataFrame:
    """turns with pos, their place in the conversation from 1: by turn (null first), then key.

    Ranges of (conv, turn) are the partitions, so a conversation of very many turns is many of them. Turns are
    counted in each; what lies ahead of a partition is known from the few conversations that cross a border.
    """
    order = ["conv", F.col("turn").asc_nulls_first(), "key", "tie"]
    ranged = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(turns), *order)
    placed = checkpointed(
        ranged.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    )
    counts = placed.groupBy("conv", "part").count()
    ahead = F.sum("count").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    crossing = counts.withColumn("ahead", ahead).where("ahead > 0").drop("count")  # one row a partition at most
    local = F.row_number().over(Window.partitionBy("conv", "part").orderBy("row"))
    met = placed.withColumn("local", local).join(F.broadcast(crossing), ["conv", "part"], "left")
    return checkpointed(met.select("conv", (F.col("local") + F.coalesce("ahead", F.lit(0))).alias("pos"), "key", "words"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, total) and (conv, total, pos, key, words): the first turns of conversation conv - conv % 20, then the own ones."""
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("own"))
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    convs = sizes.select("conv", "own", taken.alias("h"), (F.col("conv") - F.col("conv") % 20).alias("base"))
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("own").alias("there")), "base", "left")
    convs = convs.withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    convs = checkpointed(convs.withColumn("total", F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).drop("own", "there"))
    first = turns.where("pos <= 3").withColumnRenamed("conv", "base")
    begun = convs.where("m > 0").join(first, "base").where("pos <= m").select("conv", "total", "pos", "key", "words")
    rest = turns.join(convs, "conv").where("pos > h").select("conv", "total", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "key", "words")
    return convs.select("conv", "total"), begun.unionByName(rest)


def blocks_of(convs: DataFrame, turns: DataFrame, size: int) -> DataFrame:
    """conv, block, last, keys, words and one, two: what names the block's turns. Turnless conversations have an empty block 0."""
    cut = turns.withColumn("block", F.floor((F.col("pos") - 1) / size)).groupBy("conv", "block").agg(
        F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("pos", "key", "words"))).alias("seq")
    )
    rows = cut.select("conv", "block", "total", F.col("seq.key").alias("keys"), F.col("seq.words").alias("words"))
    none = convs.where("total = 0").select(
        "conv", F.lit(0).cast("long").alias("block"), "total", F.array().cast("array<binary>").alias("keys"), F.array().cast("array<long>").alias("words")
    )
    rows = rows.unionByName(none).withColumn("last", (F.col("block") + 1) * size >= F.col("total")).drop("total")
    return rows.withColumns({"one": F.xxhash64(F.lit("one"), "keys"), "two": F.xxhash64(F.lit("two"), "keys")})


def looked_up(rows: DataFrame, table: DataFrame, key: list[str], weight: str, total: int) -> DataFrame:
    """rows with the columns of table (one row a key). Keys that weigh a HOT_SHARE of the total come by broadcast, and
    their rows are spread over all tasks of the join with the others."""
    hot, cold = table.where(F.col(weight) > total * HOT_SHARE), table.where(F.col(weight) <= total * HOT_SHARE)
    pack = lambda df, name: df.select(*key, F.struct(*[x for x in table.columns if x not in key]).alias(name))
    met = rows.join(F.broadcast(pack(hot, "hot")), key, "left")
    spread = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("rep"), F.lit(4096))).otherwise(-1).cast("int")
    met = met.withColumn("spread", spread).join(pack(cold, "cold").withColumn("spread", F.lit(-1)), [*key, "spread"], "left")
    found = F.coalesce("hot", "cold")
    return met.select(*rows.columns, *[found[x].alias(x) for x in table.columns if x not in key])


def burst(entries: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Containers of `capacity` turns at most, the trie heads, and the entries that end at a head inside.

    entries: head (the node all of a container hang on, named by its smallest conversation), keys, words, rep, n and others.
    A container that holds more is burst: its head becomes a node, and each next turn is the head of a container of its own.
    path has the heads on the way from the first one.
    """
    held = F.col("left").cast("long")
    state = entries.withColumn("left", F.size("keys"))
    sizes = state.groupBy("head").agg(F.sum(held).alias("turns"))
    total = sizes.agg(F.sum("turns")).first()[0] or 0
    state = checkpointed(looked_up(state, sizes, ["head"], "turns", total).withColumn("path", F.array("head")))
    heads = state.groupBy("head").agg(F.sum("n").alias("n_convs")).select(
        F.col("head").alias("conv"), F.lit(0).alias("at"), F.lit(None).cast("long").alias("parent"), "n_convs",
        F.lit(0).cast("long").alias("words"), F.array("head").alias("path"),
    )
    ready, stops, at = [], [], 0
    while True:
        ready.append(state.where(F.col("turns") <= capacity).withColumn("at", F.lit(at)))
        full = state.where(F.col("turns") > capacity)
        if full.isEmpty():
            break
        stops.append(full.where("left = 0").select(F.col("head").alias("conv"), F.lit(at).alias("at"), "end_rep"))
        going = full.where("left > 0").withColumn("next", F.get("keys", F.lit(at))).withColumn("left", F.col("left") - 1)
        groups = checkpointed(going.groupBy("head", "next").agg(
            F.min("rep").alias("conv"), F.sum("n").alias("n_convs"), F.first(F.get("words", F.lit(at))).alias("words_here"),
            F.sum(held).alias("held"), F.first("path").alias("way"),
        ))
        at += 1
        heads = heads.unionByName(groups.select(
            "conv", F.lit(at).alias("at"), F.col("head").alias("parent"), "n_convs", F.col("words_here").alias("words"),
            F.array_append("way", F.col("conv")).alias("path"),
        ))
        groups = groups.select("head", "next", "conv", "held")
        state = looked_up(going.drop("turns"), groups, ["head", "next"], "held", total)
        state = state.withColumns({"head": F.col("conv"), "turns": F.col("held"), "path": F.array_append("path", F.col("conv"))})
        state = checkpointed(state.drop("conv", "held", "next"))
    ended = heads.where("false").select("conv", "at", F.lit(None).cast("long").alias("end_rep"))
    for one in stops:
        ended = ended.unionByName(one)
    out = ready[0]
    for one in ready[1:]:
        out = out.unionByName(one)
    return out, heads, ended


SWEPT = "inner boolean, conv long, at int, parent long, n_convs long, n_children long, n_leaves long, saved long, end_rep long, path array<long>"


class Container:
    """Sorted suffixes of one container, swept into the nodes below its head."""

    def __init__(self, head: int, at: int, path: list):
        self.head, self.at, self.path = head, at, path
        # a node: smallest conversation, conversations, words, parent, children, leaves, saved, end_rep
        self.nodes = [[None, 0, 0, None, 0, 0, 0, None]]
        self.open, self.keys = [0], []

    def close(self, depth: int) -> None:
        while len(self.open) - 1 > depth:
            node = self.nodes[self.open.pop()]
            node[5] += not node[4]
            node[6] += (node[1] - 1) * node[2]
            above = self.nodes[node[3]]
            above[0] = node[0] if above[0] is None else min(above[0], node[0])
            above[1] += node[1]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]

    def add(self, keys, words, rep, n, end_rep, children, leaves, saved) -> None:
        shared, before = 0, self.keys
        while shared < len(before) and shared < len(keys) and keys[shared] == before[shared]:
            shared += 1
        self.close(shared)
        for k in words[shared:]:
            self.nodes.append([None, 0, k, self.open[-1], 0, 0, 0, None])
            self.open.append(len(self.nodes) - 1)
        node = self.nodes[self.open[-1]]
        node[0] = rep if node[0] is None else min(node[0], rep)
        node[1] += n
        node[4] += children
        node[5] += leaves
        node[6] += saved
        node[7] = end_rep
        self.keys = keys

    def rows(self):
        self.close(0)
        top = self.nodes[0]
        top[0] = self.head
        depth = [0] * len(self.nodes)
        yield False, self.head, self.at, None, top[1], top[4], top[5] + (not top[4]), top[6], top[7], self.path
        for k, node in enumerate(self.nodes[1:], 1):
            depth[k] = depth[node[3]] + 1
            yield True, node[0], self.at + depth[k], self.nodes[node[3]][0], node[1], node[4], node[5], node[6], node[7], None


def sweep(batches):
    """Rows sorted by (head, at, keys) to rows of SWEPT: one container at a time is held."""
    names = [x.split()[0] for x in SWEPT.split(", ")]
    types = [pa.bool_(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.list_(pa.int64())]
    held, out = None, []

    def batch():
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        out.clear()
        return done

    for wide in batches:
        for low in range(0, len(wide), READ_ROWS):
            part = wide.slice(low, READ_ROWS)
            for head, at, path, keys, words, *rest in zip(*(part.column(i).to_pylist() for i in range(part.num_columns))):
                if held is None or (head, at) != (held.head, held.at):
                    if held:
                        out.extend(held.rows())
                    held = Container(head, at, path)
                held.add(keys, words, *rest)
            if len(out) > 10_000:
                yield batch()
    if held:
        out.extend(held.rows())
    if out:
        yield batch()


def trie_level(entries: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """The nodes below the first heads, and the first heads themselves, both as conv, at, parent, n_convs, n_children, n_leaves, saved, end_rep."""
    ready, heads, ended = burst(entries, capacity)
    suffix = lambda x: F.slice(x, F.col("at") + 1, F.greatest(F.size(x) - F.col("at"), F.lit(0)))
    rows = ready.select(
        "head", "at", "path", suffix("keys").alias("keys"), suffix("words").alias("words"), "rep", "n", "end_rep",
        "more_children", "more_leaves", "more_saved",
    )
    # containers are dealt to shards, sorted there and swept
    dealt = rows.repartition(shuffle_partitions(rows), "head", "at").sortWithinPartitions("head", "at", "keys")
    swept = checkpointed(dealt.mapInArrow(sweep, SWEPT))
    columns = ["conv", "at", "parent", "n_convs", "n_children", "n_leaves", "saved", "end_rep"]
    # what containers and heads hold counts for all heads above them
    zero, nothing = F.lit(0).cast("long"), F.lit(None).cast("long")
    tops = swept.where("not inner")
    up = tops.select(F.posexplode("path").alias("at", "conv"), F.col("n_leaves").alias("leaves"), F.col("saved").alias("saved"), zero.alias("children"), nothing.alias("end_rep"))
    own = (F.col("n_convs") - 1) * F.col("words")
    parts = [
        up,
        heads.select(F.posexplode("path").alias("at", "conv"), zero.alias("leaves"), own.alias("saved"), zero.alias("children"), nothing.alias("end_rep")),
        tops.select("at", "conv", zero.alias("leaves"), zero.alias("saved"), F.col("n_children").alias("children"), "end_rep"),
        heads.where("at > 0").select((F.col("at") - 1).alias("at"), F.col("parent").alias("conv"), zero.alias("leaves"), zero.alias("saved"), F.lit(1).cast("long").alias("children"), nothing.alias("end_rep")),
        ended.select("at", "conv", zero.alias("leaves"), zero.alias("saved"), zero.alias("children"), "end_rep"),
    ]
    given = parts[0]
    for part in parts[1:]:
        given = given.unionByName(part)
    sums = given.groupBy("conv", "at").agg(
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("end_rep").alias("end_rep")
    )
    known = checkpointed(heads.join(sums, ["conv", "at"]).select(*columns))
    return swept.where("inner").select(*columns).unionByName(known.where("at > 0")), known.where("at = 0")


def ends(blocks: DataFrame) -> DataFrame:
    """end_rep, ends_sha256: the ids of the conversations with the same turns, under the smallest of them.

    Ids of large groups are range-partitioned, joined to pieces, and the pieces of a group hashed in order, so no task holds a
    group; one task hashes the bytes of one.
    """
    last = blocks.where("last").select("conv", "block", "all_one", "all_two")
    groups = last.groupBy("block", "all_one", "all_two").agg(F.min("conv").alias("rep"), F.count("*").alias("n"))
    alone = groups.where("n = 1").select(F.col("rep").alias("end_rep"), F.sha2(F.col("rep").cast("string"), 256).alias("ends_sha256"))
    many = groups.where("n > 1")
    total = last.count()
    members = looked_up(last.withColumn("rep", F.col("conv")), many.select("block", "all_one", "all_two", F.col("rep").alias("end_rep"), "n"), ["block", "all_one", "all_two"], "n", total)
    members = members.where("end_rep is not null").select("end_rep", "conv")
    parts = shuffle_partitions(blocks)
    pieces = members.repartitionByRange(parts, "end_rep", "conv").sortWithinPartitions("end_rep", "conv").mapInArrow(
        joined_ids, "end_rep long, first long, ids string"
    )
    hashed = pieces.repartition(parts, "end_rep").sortWithinPartitions("end_rep", "first").mapInArrow(
        hashed_pieces, "end_rep long, ends_sha256 string"
    )
    return alone.unionByName(hashed)


def joined_ids(batches):
    group, first, ids, size = None, None, [], 0
    out = []
    for batch in batches:
        for rep, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (rep != group or size > PIECE):
                out.append((group, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                group, first = rep, conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if len(out) > 64:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["end_rep", "first", "ids"])
            out = []
    if ids:
        out.append((group, first, ",".join(ids)))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["end_rep", "first", "ids"])


def hashed_pieces(batches):
    group, state = None, None
    for batch in batches:
        out = []
        for rep, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if rep != group:
                if state:
                    out.append((group, state.hexdigest()))
                group, state = rep, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["end_rep", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([state.hexdigest()])], names=["end_rep", "ends_sha256"])


def chained(blocks: DataFrame) -> DataFrame:
    """blocks with all_one, all_two (what names the turns up to the block's end) and from_one, from_two (up to its beginning)."""
    upto = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    lane = lambda x: F.bit_xor(F.xxhash64("block", x)).over(upto)
    rows = blocks.withColumns({"all_one": lane("one"), "all_two": lane("two")})
    before = lambda x: F.col(f"all_{x}").bitwiseXOR(F.xxhash64("block", x))
    return rows.withColumns({"from_one": before("one"), "from_two": before("two")})


def conversation_trie(conversations: DataFrame, capacity: int = CAPACITY, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Suffixes of all conversations begin in one container under the root. A container that holds more than `capacity` turns bursts by
    next turn; the others are dealt to shards, sorted and swept into nodes. Conversations of equal turns are one suffix
    with a count, so they burst nothing. Turns beyond `block_turns` are containers of their own, under the node where the block before ends,
    and are done first.

    Rows without conv_id take no part; a null role or text counts as empty. Turns of one number are put in order by a digest of role
    and text, and repeated rows are turns each. conv % 20 has the sign of conv. A conversation without turns of its own is not
    known, one whose rebuilt form is turnless counts for the root. An empty table gives no rows. Other columns play no part. Texts of any length are
    replaced by digests first.
    """
    columns = conversations.select("conv_id", "turn", "role", "text")
    convs, turns = rebuilt(numbered(turns_of(columns)))
    blocks = checkpointed(chained(blocks_of(convs, turns, block_turns)))
    deepest = blocks.agg(F.max("block")).first()[0] or 0
    below, found = None, None
    for level in range(deepest, -1, -1):
        rows = blocks.where(F.col("block") == level)
        if level:
            over = blocks.where(F.col("block") == level - 1).select("conv", F.col("all_one").alias("from_one"), F.col("all_two").alias("from_two"))
            over = over.groupBy("from_one", "from_two").agg(F.min("conv").alias("head"))
            rows = rows.join(over, ["from_one", "from_two"])
        else:
            rows = rows.join(F.broadcast(blocks.agg(F.min("conv").alias("head"))), F.lit(True))
        entries = rows.groupBy("head", "one", "two").agg(
            F.min("conv").alias("rep"), F.count("*").alias("n"), F.min(F.when(F.col("last"), F.col("conv"))).alias("end_rep"),
            F.first("keys").alias("keys"), F.first("words").alias("words"),
        ).drop("one", "two")
        if below is None:
            more = {f"more_{x}": F.lit(0).cast("long") for x in ("children", "leaves", "saved")}
            entries = entries.withColumns(more)
        else:
            entries = entries.join(below, "rep", "left").withColumns({f"more_{x}": F.coalesce(f"more_{x}", F.lit(0)) for x in ("children", "leaves", "saved")})
        nodes, tops = trie_level(entries, capacity)
        below = tops.select(
            F.col("conv").alias("rep"), F.col("n_children").alias("more_children"), F.col("n_leaves").alias("more_leaves"), F.col("saved").alias("more_saved")
        )
        nodes = nodes if level else nodes.unionByName(tops)
        nodes = nodes.withColumn("depth", F.col("at").cast("long") + level * block_turns)
        found = nodes if found is None else found.unionByName(nodes)
    return found.join(ends(blocks), "end_rep", "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
