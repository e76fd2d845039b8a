"""Near duplicates: by SimHash and an inverted index over byte positions, and by shingle sets and a prefix filter."""

from __future__ import annotations

import itertools
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import checkpointed, few, give_back, whole_text
from tidebar.llm.components import components

#: Seed of the shingle hash and shingles hashed at a time, so one very long text needs bounded memory.
SEED, STEP = 42, 1 << 13
#: Fingerprints of an index entry that are compared pair by pair; larger entries take the way over midpoints.
PAIRWISE = 32


def shingle_hashes(text: bytes, width: int):
    """uint64 arrays, together the XXH64 of all word shingles; fewer words than width give one shingle, none none."""
    words = text.lower().split()
    if not words:
        return
    if len(words) < width:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
        return
    count = len(words) - width + 1
    for start in range(0, count, STEP):
        part = words[start : min(start + STEP, count) + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width))))
        yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(part) - width + 1)


def lanes_of(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """Each hash as `lanes` words of 64 bits: itself first, then mixed copies."""
    out = [hashes]
    for k in range(1, lanes):
        x = hashes + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, axis=1)


def simhash(text: bytes, width: int, lanes: int = 1) -> bytes:
    """The fingerprint of all shingles, repeats included."""
    return print_of(shingle_hashes(text, width), lanes)


def print_of(parts, lanes: int = 1) -> bytes:
    """8 bytes a lane, highest first; a bit is 1 if over half of the hashes have it. No hashes: zeros."""
    ones, total = np.zeros(64 * lanes, dtype=np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(lanes_of(hashes, lanes).astype(">u8").view(np.uint8)).reshape(-1, 64 * lanes)
        ones += bits.sum(axis=0, dtype=np.int32)
        total += len(hashes)
    return np.packbits(2 * ones > total).tobytes() if total else bytes(8 * lanes)


def fingerprint(width: int, lanes: int = 1) -> Column:
    """Column of binary fingerprints of the whole texts."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(x.as_py().encode(), width, lanes) for x in texts], pa.binary())

    return of(whole_text())


def byte_at(column: str, position: int) -> Column:
    """Byte `position` (0 the highest) of a long."""
    return F.shiftrightunsigned(F.col(column), 56 - 8 * position).bitwiseAND(F.lit(255))


def postings(prints: DataFrame) -> DataFrame:
    """fp, entry, rest: the inverted index.

    Fingerprints at 2 or fewer differing bits share 6 of 8 positional bytes at least. Cut the positions into four
    neighbouring twos: two of the four are then untouched. An entry is two such twos, so it holds four positional
    bytes with their positions, and each such pair of fingerprints meets in one entry at least. rest keeps the other
    four bytes.
    """
    entries = []
    for number, (i, j) in enumerate(itertools.combinations(range(4), 2)):
        two = [F.shiftrightunsigned(F.col("fp"), 48 - 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
        others = [k for k in range(4) if k not in (i, j)]
        entries.append(F.struct(
            (F.lit(number).cast("long") * (1 << 32) + two[i] * (1 << 16) + two[j]).alias("entry"),
            (two[others[0]] * (1 << 16) + two[others[1]]).alias("rest"),
        ))
    return prints.select("fp", F.inline(F.array(*entries)))


def links(prints: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints `fp` (long) with 2 or fewer differing bits.

    Within an entry of up to `pairwise` fingerprints, pairs are tallied: 6 shared positional bytes or more stay, then
    the bits are counted. In larger entries, each fingerprint goes to its rest and the 32 neighbours of it at one bit;
    two that meet there differ in two bits at most, and all at two bits meet, so a star around the smallest
    has the same components as all pairs would have, and nothing is dropped.
    """
    index = postings(prints)
    sizes = index.groupBy("entry").count().where("count > 1")
    met = checkpointed(index.join(sizes, "entry"))
    few = met.where(F.col("count") <= pairwise)
    left, right = few.select("entry", F.col("fp").alias("a")), few.select("entry", F.col("fp").alias("b"))
    shared = sum((byte_at("a", k) == byte_at("b", k)).cast("int") for k in range(8))
    pairs = (
        left.join(right, "entry").where("a < b").where(shared >= 6)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")
    )
    flips = F.array(F.col("rest"), *[F.col("rest").bitwiseXOR(F.lit(1 << k)) for k in range(32)])
    many = met.where(F.col("count") > pairwise).select("fp", "entry", F.explode(flips).alias("middle"))
    hubs = many.groupBy("entry", "middle").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = many.join(hubs, ["entry", "middle"]).select(F.col("fp").alias("a"), "b").where("a <> b")
    return pairs.unionByName(stars).distinct()


def simhash_groups(docs: DataFrame, width: int = 3, pairwise: int = PAIRWISE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of 2 or fewer differing bits reach. Texts without words, null among
    them, have fingerprint zero and link like any other. Repeated rows stay; null ids never become a
    component_id unless a component has no other. An empty table gives no rows.
    """
    rows = checkpointed(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.conv(F.hex(fingerprint(width)), 16, -10).cast("long").alias("fp"),
    ))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(prints.select("fp"), pairwise))
    classes = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        prints["fp"], "first", F.coalesce("root", prints["fp"]).alias("root")
    )
    classes = checkpointed(classes)
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# near duplicates by similarity -------------------------------------------------------------------------------------

#: Longs of the sketch of a shingle set; the share (one in so many) of texts whose shingles are counted, and the count
#: there from which a shingle is common; bits of a shingle's hash that name its place among the common ones.
SKETCH, SAMPLED, COMMON, PLACES = 8, 16, 3, 22
#: Longs of a wide sketch at most; one long for 32 members, a power of two.
WIDEST = 1 << 12
#: Hexadecimal digits of a text's digest that number its node, and texts whose number is taken, at most.
DIGITS, CLASHES = 15, 10_000
#: Bits of a node's number that name its place among the nodes whose sets are wanted.
WANTED = 24
#: Rounds of stars at most, and comparisons for each row of the index that end them.
ROUNDS, WORK = 4, 4
#: Two similar sets share an entry more for each so many members of the smaller one.
SPREAD = 100


def distinct_shingles(text: bytes, width: int) -> np.ndarray:
    """The XXH64 of a text's word shingles as a sorted set."""
    parts = [np.unique(h) for h in shingle_hashes(text, width)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def shingle_set(width: int):
    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        return listed([distinct_shingles((x.as_py() or "").encode(), width).view(np.int64) for x in texts])

    return of


def listed(rows: list[np.ndarray]) -> pa.Array:
    stops = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64()))


def common_levels(docs: DataFrame, width: int) -> np.ndarray:
    """For the first PLACES bits of a hash, how common the shingles there are, by a sample of the texts: 0 for what is
    rare, else the logarithm of the count. Any such table is right for an order; this one puts rare shingles first."""
    sample = docs.select(whole_text().alias("text")).where(F.xxhash64("text") % SAMPLED == 0)
    counts = sample.select(F.explode(shingle_set(width)(F.col("text"))).alias("h")).groupBy("h").count().where(F.col("count") >= COMMON)
    found = counts.groupBy(F.shiftrightunsigned("h", 64 - PLACES).cast("int").alias("place")).agg(
        F.max(F.log2("count")).cast("byte").alias("level")
    ).toArrow()  # 2**PLACES rows at most, for any input
    levels = np.zeros(1 << PLACES, np.uint8)
    levels[np.asarray(found["place"])] = np.asarray(found["level"])
    return levels


def sketches(docs: DataFrame, width: int, similarity: float) -> Column:
    """Column of structs: size of the shingle set; fp, its SimHash; sketch, the parity of its members at each of 64 * SKETCH places, which
    differs for two sets at no more places than they have members that only one of them holds; wide, the same with
    two places or more for each member; prefix, its
    first members in one order for all texts, so many that two sets of the similarity share `asked` of them at least."""
    shared = docs.sparkSession.sparkContext.broadcast(common_levels(docs, width).tobytes())

    @F.arrow_udf("struct<size:int,fp:long,sketch:array<long>,wide:array<long>,prefix:array<long>>")
    def of(texts: pa.Array) -> pa.Array:
        levels = np.frombuffer(shared.value, np.uint8)
        sizes, fp, sketch, wide, prefix = [], [], [], [], []
        for x in texts:
            found = distinct_shingles(x.as_py().encode(), width)
            sizes.append(len(found))
            fp.append(int.from_bytes(print_of(found[k : k + STEP] for k in range(0, len(found), STEP)), "big", signed=True))
            sketch.append(parity(found, SKETCH))
            wide.append(parity(found, min(WIDEST, max(SKETCH, 1 << (len(found) // 32).bit_length()))))
            # similar sets share similarity * size members; the texts without words share 0
            shared_least = int(np.ceil(similarity * len(found) - 1e-9))
            first = len(found) - shared_least + max(1, min(1 + len(found) // SPREAD, shared_least))
            order = np.lexsort((found, levels[found >> np.uint64(64 - PLACES)]))[:first]
            prefix.append(found[order].view(np.int64) if len(found) else np.zeros(1, np.int64))
        columns = [pa.array(sizes, pa.int32()), pa.array(fp, pa.int64()), listed(sketch), listed(wide), listed(prefix)]
        out = pa.StructArray.from_arrays(columns, names=["size", "fp", "sketch", "wide", "prefix"])
        del columns, sketch, wide, prefix
        give_back()
        return out

    return of(whole_text())


def parity(members: np.ndarray, longs: int) -> np.ndarray:
    """For each of 64 * longs places (a power of two) whether an odd number of members lie there."""
    odd = np.bincount((members & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_be_similar(similarity: float) -> Column:
    """False only for pairs (size_a, sketch_a, size_b, sketch_b) whose sets surely lack the similarity."""
    bits = sum(F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(SKETCH))
    return near_in_size(similarity) & (bits <= most_apart(similarity))


def most_apart(similarity: float) -> Column:
    """Members that only one of two sets of the similarity holds, at most."""
    return (F.col("size_a") + F.col("size_b")) * ((1 - similarity) / (1 + similarity)) + 1e-9


def likely_by_wide(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs that the wide sketches do not rule out, the longer one folded to the length of the other."""
    first = F.size("wide_a") <= F.size("wide_b")
    short, long = F.when(first, F.col("wide_a")).otherwise(F.col("wide_b")), F.when(first, F.col("wide_b")).otherwise(F.col("wide_a"))
    steps = F.least(F.size("wide_a"), F.size("wide_b"))
    nothing = F.lit(0).cast("long")
    folded = lambda i: F.aggregate(
        F.sequence(i, F.greatest(F.size("wide_a"), F.size("wide_b")) - 1, F.col("steps")), nothing, lambda x, j: x.bitwiseXOR(F.get("long", j))
    )
    bits = F.aggregate(F.sequence(F.lit(0), F.col("steps") - 1), F.lit(0), lambda n, i: n + F.bit_count(F.get("short", i).bitwiseXOR(folded(i))))
    return pairs.withColumns({"short": short, "long": long, "steps": steps}).where(bits <= most_apart(similarity))


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, rounds: int = ROUNDS, digits: int = DIGITS) -> DataFrame:
    """One row per document: doc_id, text_sha256, group_doc, group_sha256, kept; groups of texts that links of `width`-word
    shingle sets of Jaccard similarity `similarity` or more reach.

    The groups are those of all pairs. First, texts whose sets have SimHashes at 2 or fewer differing bits, found by the index over
    byte positions and its count filter (`links`), are checked exactly. For pairs that lie further apart, texts of different
    groups meet in an index over the prefixes of their shingle sets, rare shingles first; two of the similarity share a
    shingle there. Where that is much to compare, each text is first compared with a centre of each of its entries, in
    rounds; then all pairs of an entry that are not yet in one group are compared, whatever its size. Sizes and
    sketches rule out pairs that cannot be similar; the sets decide the rest. The first document (smallest doc_id, then digest) of a
    group stays. Texts without words form one group.
    """
    # texts of one digest are one node; its number follows from the digest
    written = checkpointed(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(whole_text().cast("binary"), 256).alias("text_sha256"),
        sketches(docs, width, similarity).alias("set"),
    ))
    node = node_number(written, digits)
    rows = written.withColumn("node", node)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_sha256")
    sets = checkpointed(rows.groupBy("node").agg(*[F.first(f"set.{c}").alias(c) for c in ("size", "fp", "sketch", "wide")]))
    edges = similar(docs, node, sets, print_links(sets.select("node", "fp")), width, similarity)
    groups = checkpointed(components(edges))
    # entries of one text alone go, and those of just two whose sizes are too far apart: bounds of an entry are a partial
    # row a task, and the join back splits long entries
    index = rows.select("node", F.col("set.size").alias("size"), F.explode("set.prefix").alias("entry"))
    bounds = index.groupBy("entry").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.min("size").alias("least"), F.max("size").alias("most"), F.count("*").alias("n")
    ).where("low < high").where((F.col("n") > 2) | (F.col("least") >= F.col("most") * similarity - 1e-9))
    met = checkpointed(index.join(bounds.select("entry"), "entry").distinct())
    total = met.count()
    waiting, before = unsettled(met, groups), None
    for number in range(rounds):
        work = waiting.where("root <> most").agg(F.sum("n")).first()[0] or 0
        # a round that leaves nearly all of the work found what there was to find
        if work <= WORK * total or before and work > 0.9 * before:
            break
        before = work
        first = F.xxhash64("node", F.lit(number))
        if number:  # what is left is compared with the largest group
            first = F.when(F.col("root") == F.col("most"), first)
        centre = waiting.groupBy("entry").agg(F.min_by(F.struct("node", "root", "size"), first).alias("c"))
        stars = waiting.join(centre, "entry").where("root <> c.root").select(
            F.col("node").alias("node_a"), F.col("size").alias("size_a"), F.col("c.node").alias("node_b"), F.col("c.size").alias("size_b")
        )
        found = similar(docs, node, sets, sharing(stars, similarity, 4), width, similarity)
        if found.isEmpty():
            break
        edges = edges.unionByName(found)
        waiting = unsettled(met, checkpointed(components(edges)))
    # in each entry, the texts outside its largest group with all of other groups
    both = waiting.join(sets.select("node", "sketch"), "node")
    name = lambda df, x: df.select("entry", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "most", "size", "sketch")])
    left, right = name(both.where("root <> most"), "a"), name(both, "b")
    pairs = left.join(right, "entry").where("root_a <> root_b and (root_b = most_b or node_a < node_b)").where(may_be_similar(similarity))
    edges = edges.unionByName(similar(docs, node, sets, sharing(pairs, similarity), width, similarity))
    roots = components(edges)
    named = rows.select("doc_id", "text_sha256", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = checkpointed(named.select("doc_id", "text_sha256", "root"))
    heads = named.groupBy("root").agg(F.min(order).alias("head"))
    return named.join(heads, "root").select(
        "doc_id", "text_sha256", F.col("head.doc_id").alias("group_doc"), F.col("head.text_sha256").alias("group_sha256"),
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_sha256") == F.col("head.text_sha256"))).alias("kept"),
    )


def asked(size: Column, similarity: float) -> Column:
    """Entries that two similar sets of this size or more share at least.

    Sets of the similarity share similarity * size members or more, whichever of the two is meant. A prefix lacks as many of its
    set, less what is asked; so it holds as many of the first shared ones in the order, and two prefixes share the lesser number.
    """
    return F.greatest(F.lit(1), F.least(1 + F.floor(size / SPREAD), F.ceil(similarity * size - 1e-9)))


def near_in_size(similarity: float) -> Column:
    return F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * similarity - 1e-9


def sharing(met: DataFrame, similarity: float, share: int = 1) -> DataFrame:
    """Pairs (a, b) of nodes, a the smaller, from a row for each entry that two nodes share: those near in size that share the
    entries asked, or one in `share` of these where met has only some of the entries. Texts that meet by a few shingles go here."""
    rows = met.where(near_in_size(similarity)).select(
        F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), F.least("size_a", "size_b").alias("size")
    )
    counts = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("size").alias("size"))
    return counts.where(F.col("n") * share >= asked(F.col("size"), similarity)).select("a", "b")


def print_links(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that join the nodes whose fingerprints `fp` are equal or differ in 2 or fewer bits, a the smaller."""
    firsts = checkpointed(sets.groupBy("fp").agg(F.min("node").alias("first")))
    of = lambda x: firsts.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}"))
    linked = links(firsts.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    same = sets.join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return linked.unionByName(same)


def node_number(rows: DataFrame, digits: int) -> Column:
    """The number of a row's text_sha256: its first digits. Of several digests that begin alike, the smallest has
    that number and the others get negative ones, which travel as a list; beyond CLASHES of them it is an error."""
    base = F.conv(F.substring("text_sha256", 1, digits), 16, 10).cast("long")
    taken = rows.groupBy(base.alias("number")).agg(F.min("text_sha256").alias("first"), F.max("text_sha256").alias("last")).where("first <> last")
    clashing = rows.select("text_sha256", base.alias("number")).join(taken, "number").where("text_sha256 <> first")
    found = [r[0] for r in clashing.select("text_sha256").distinct().orderBy("text_sha256").limit(CLASHES + 1).collect()]
    if len(found) > CLASHES:
        raise ValueError("too many digests begin alike")
    if not found:
        return base
    pairs = [F.lit(x) for k, sha in enumerate(found) for x in (sha, -1 - k)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("text_sha256")), base).cast("long")


def unsettled(met: DataFrame, groups: DataFrame) -> DataFrame:
    """node, entry, size, root, most, n: the entries that hold texts of several groups, with the root of the largest of these and the
    number of texts."""
    rooted = checkpointed(met.join(groups, "node", "left").select("node", "entry", "size", F.coalesce("root", "node").alias("root")))
    sizes = rooted.groupBy("entry", "root").count().groupBy("entry").agg(
        F.max_by("root", F.struct("count", "root")).alias("most"), F.sum("count").alias("n"), F.count("*").alias("kinds")
    )
    return checkpointed(rooted.join(sizes.where("kinds > 1").drop("kinds"), "entry"))


def similar(docs: DataFrame, node: Column, sets: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have the similarity: by size and wide sketch first, then exactly. A short list has
    few partitions: lists of several rounds go into one, whose partitions are tasks of each round to come."""
    wide = lambda x: sets.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("wide").alias(f"wide_{x}"))
    likely = pairs.join(wide("a"), "a").join(wide("b"), "b").where(near_in_size(similarity))
    likely = checkpointed(likely_by_wide(likely, similarity).select("a", "b"))
    count = likely.count()
    if not count:
        return few(likely, 0)
    # exact check: the whole sets of the texts that a likely pair names; only these (and a few by chance) are shuffled
    wanted = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets_of = checkpointed(
        docs.select(whole_text().alias("text")).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).withColumn("node", node)
        .select("node", wanted_sets(wanted, width)(F.col("node"), F.col("text")).alias("shingles"))
        .where(F.col("shingles").isNotNull()).groupBy("node").agg(F.first("shingles").alias("shingles"))
    )
    both = F.size(F.array_intersect("x", "y"))
    whole = F.size("x") + F.size("y") - both
    checked = (
        likely.join(sets_of.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets_of.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", F.when(whole == 0, 1.0).otherwise(both / whole).alias("likeness"))
    )
    # written by all tasks, then read by few
    return few(checkpointed(checked.where(F.col("likeness") >= similarity).select("a", "b")), count)


def wanted_sets(wanted: DataFrame, width: int):
    """Shingle sets of texts by node, null where no wanted node has the place; places are a table of fixed size."""
    places = wanted.select(F.pmod("node", F.lit(1 << WANTED)).cast("int").alias("place")).distinct().toArrow()
    table = np.zeros(1 << WANTED, bool)
    table[np.asarray(places["place"])] = True
    shared = wanted.sparkSession.sparkContext.broadcast(np.packbits(table).tobytes())

    @F.arrow_udf("array<long>")
    def of(nodes: pa.Array, texts: pa.Array) -> pa.Array:
        place = np.asarray(nodes) % (1 << WANTED)
        held = np.frombuffer(shared.value, np.uint8)[place >> 3] >> (7 - (place & 7)) & 1
        out = [distinct_shingles(x.as_py().encode(), width).view(np.int64) if h else np.zeros(0, np.int64) for x, h in zip(texts, held)]
        found = listed(out)
        del out
        give_back()
        return pa.ListArray.from_arrays(found.offsets, found.values, mask=pa.array(held == 0))

    return of


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near_duplicates; all columns stay."""
    found = near_duplicates(docs, width, similarity)
    kept = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    keyed = docs.withColumn("__sha256", F.sha2(whole_text().cast("binary"), 256))
    match = keyed["doc_id"].eqNullSafe(kept["__id"]) & (keyed["__sha256"] == kept["__sha"])
    return keyed.join(kept, match, "left_semi").select(*[keyed[c] for c in docs.columns])
