"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidebar.llm.common import checkpointed, shuffle_partitions, whole_text

#: Bytes of a block. A document of n blocks takes log2(n) rounds of pair names.
BLOCK = 2048


def dense_names(rows: DataFrame, key: list[str], tie: list[str], carry: list[str], lead: str | None = None) -> DataFrame:
    """carry columns with `name`, the dense number (from 0) of the row's key among all sorted distinct keys.

    Rows are range-partitioned on lead (a number that follows from the key, so that the sampled bounds stay short; by
    default the key itself) and tie, so one hot key spreads over as many partitions as it fills. Each task
    numbers the keys that it sees; a key that goes on in the next task gets no second number. What meets on the
    driver is one row a task: lead, digest of first and last key, number of keys. Should keys of the same lead mix
    across a boundary, the work is done again with the keys themselves as bounds.
    """
    spark = rows.sparkSession
    parts = shuffle_partitions(rows)
    leads = [lead] if lead else key
    ranged = rows.repartitionByRange(parts, *leads, *tie).sortWithinPartitions(*dict.fromkeys([*leads, *key, *tie]))
    kept = ranged.select(*carry).schema
    fields = [ranged.schema[k] for k in key]
    heads = ["__part", "__local", "__first_lead", "__first", "__last_lead", "__last"]
    schema = "__part long, __local long, __first_lead string, __first binary, __last_lead string, __last binary, " + ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in kept
    )

    def packed(batch, at):
        parts = (batch.column(f.name)[at].as_py() for f in fields)
        value = b"\0".join(v if isinstance(v, (bytes, bytearray)) else str(v).encode() for v in parts)
        return str(batch.column(leads[0])[at].as_py()) if lead else "", hashlib.sha256(value).digest()

    def number(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen, last, first = -1, None, None
        for batch in batches:
            count = batch.num_rows
            if not count:
                continue
            new = np.zeros(count, dtype=bool)
            for f in fields:
                values = batch.column(f.name)
                new[1:] |= np.asarray(pc.not_equal(values.slice(1), values.slice(0, count - 1)))
            head = packed(batch, 0)
            new[0] = head != last
            first = head if first is None else first
            local = seen + np.cumsum(new)
            seen, last = int(local[-1]), packed(batch, count - 1)
            none = [pa.nulls(count, pa.string()), pa.nulls(count, pa.binary())] * 2
            columns = [pa.array(np.full(count, part)), pa.array(local), *none, *(batch.column(f.name) for f in kept)]
            yield pa.RecordBatch.from_arrays(columns, names=heads + [f.name for f in kept])
        if first is not None:
            edge = [pa.array([x], k) for x, k in zip((*first, *last), (pa.string(), pa.binary()) * 2)]
            empty = [pa.nulls(1, to_arrow_type(f.dataType)) for f in kept]
            columns = [pa.array([part]), pa.array([seen]), *edge, *empty]
            yield pa.RecordBatch.from_arrays(columns, names=heads + [f.name for f in kept])

    numbered = checkpointed(ranged.mapInArrow(number, schema))
    edges = numbered.where("__first is not null").select(*heads).orderBy("__part").collect()
    if lead and any(a["__last_lead"] == b["__first_lead"] and a["__last"] != b["__first"] for a, b in zip(edges, edges[1:])):
        return dense_names(rows, key, tie, carry)
    shifts, total, before = [], 0, None
    for edge in edges:
        shift = total - 1 if edge["__first"] == before else total
        shifts.append((edge["__part"], shift))
        total, before = shift + edge["__local"] + 1, edge["__last"]
    table = spark.createDataFrame(shifts, "__part long, __shift long")
    # one row a task: its size is the number of partitions
    return (
        numbered.where("__first is null")
        .join(F.broadcast(table), "__part")
        .select(*carry, (F.col("__local") + F.col("__shift")).alias("name"))
    )


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """row, doc_id, text_sha256, level, name: equal (level, name) exactly for equal texts.

    Every text is cut into blocks of `block` bytes, distinct blocks become integers in sorted order, then the names
    of neighbours form pairs that are named anew until one name is left. level counts the rounds; a missing
    right neighbour is -1, so texts of different length never meet.
    """
    data = F.col("__bytes")
    cut = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(whole_text().cast("binary"), 256).alias("text_sha256"),
        whole_text().cast("binary").alias("__bytes"),
    )
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.octet_length(data) - 1) / block), F.lit(0)).cast("int"))
    blocks = (
        cut.withColumn("blocks", F.greatest(F.ceil(F.octet_length(data) / block), F.lit(1)).cast("long"))
        .select("row", "doc_id", "text_sha256", "blocks", F.posexplode(F.transform(starts, lambda i: F.substring(data, i * block + 1, F.lit(block)))).alias("pos", "content"))
        # the documents' own columns ride on their first block alone
        .withColumn("doc_id", F.when(F.col("pos") == 0, F.col("doc_id")))
        .withColumn("text_sha256", F.when(F.col("pos") == 0, F.col("text_sha256")))
    )
    blocks = blocks.withColumn("lead", F.xxhash64("content"))
    named = dense_names(blocks, ["content"], ["row", "pos"], ["row", "pos", "doc_id", "text_sha256", "blocks"], "lead")
    named = checkpointed(named.withColumn("pos", F.col("pos").cast("long")))
    longest = named.agg(F.max("blocks")).first()[0] or 0
    heads = named.where("pos = 0").select("row", "doc_id", "text_sha256")
    done = [named.where("blocks = 1").select("row", F.lit(0).alias("level"), "name")]
    rest, level = named.where("blocks > 1").select("row", "pos", "blocks", "name"), 0
    while longest > 1:
        level += 1
        # both names of a pair share a row and half position: one shuffle
        pairs = rest.groupBy("row", F.floor(F.col("pos") / 2).alias("half"), "blocks").agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("right"),
        )
        again = dense_names(pairs, ["left", "right"], ["row", "half"], ["row", "half", "blocks"])
        longest = (longest + 1) // 2
        again = again.select("row", F.col("half").alias("pos"), F.ceil(F.col("blocks") / 2).cast("long").alias("blocks"), "name")
        if longest > 1:
            again = checkpointed(again)
        done.append(again.where("blocks = 1").select("row", F.lit(level).alias("level"), "name"))
        rest = again.where("blocks > 1")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return heads.join(found, "row")


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, level, name.

    Of equal texts the row with the largest doc_id stays (null is smaller than any number). Null text equals empty
    text. A row that repeats with the same doc_id and text appears as often as it is there; the first of them stays.
    An empty table gives no rows; other columns of docs are not read.
    """
    rows = checkpointed(identities(docs, block))
    # a max per partition first, so a group with a third of all rows meets as a few partial rows
    groups = rows.groupBy("level", "name").agg(
        F.count("*").alias("group_size"),
        F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), (-F.col("row")).alias("row"))).alias("best"),
    )
    return rows.join(groups, ["level", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == -F.col("best.row")).alias("kept"), "text_sha256", "level", "name",
    )


def drop_exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs without the rows that exact_duplicates drops; all columns stay."""
    found = checkpointed(exact_duplicates(docs, block))
    kept = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    repeats = found.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count()
    keyed = docs.withColumn("__sha256", F.sha2(whole_text().cast("binary"), 256))
    if repeats:  # whole rows that are there twice cannot be told apart by a join
        keyed = keyed.dropDuplicates(["doc_id", "__sha256"])
    match = keyed["doc_id"].eqNullSafe(kept["__id"]) & (keyed["__sha256"] == kept["__sha"])
    return keyed.join(kept, match, "left_semi").select(*[keyed[c] for c in docs.columns])
