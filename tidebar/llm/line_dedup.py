"""Repeated runs of lines, found by prefix doubling over line numbers; later copies go. DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import checkpointed, whole_text

#: Words that a repeated run must have, over all its lines.
MIN_WORDS = 50

DOC = ["known", "id", "digest"]


def where_of(pos: str = "pos") -> Column:
    """A place in the corpus: documents in order of doc_id (null first), then of text; lines by number."""
    return F.struct(*DOC, F.col(pos).alias("pos"))


def keyed(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.withColumns({
        "known": F.col("doc_id").isNotNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")),
        "digest": F.xxhash64(text),
    })


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows whose key stands at two places or more, with `name`: the first of these places.

    A key's rows meet as one partial row a task; the join back is split where a key has very many rows.
    """
    groups = rows.groupBy(*key).agg(F.min(where_of()).alias("name"), F.max(where_of()).alias("last"))
    return rows.join(groups.where("name <> last").drop("last"), key)


def lines_of(docs: DataFrame) -> DataFrame:
    """The lines of every document by number, as two hashes and a count of words (runs without white space)."""
    lines = keyed(docs).select(*DOC, F.posexplode(F.split(whole_text(), "\n")).alias("pos", "line"))
    return lines.select(
        *DOC, "pos", F.xxhash64("line").alias("line1"), F.xxhash64(F.lit("line"), F.col("line")).alias("line2"),
        F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def doubled(runs: DataFrame, half: int) -> DataFrame:
    """From the repeated runs of `half` lines (document, pos, name) those of twice as many."""
    second = runs.select(*DOC, (F.col("pos") - half).alias("pos"), F.col("name").alias("next"))
    pairs = runs.withColumnRenamed("name", "head").join(second, [*DOC, "pos"])
    return repeated(pairs, ["head", "next"]).select(*DOC, "pos", "name")


def shortest_windows(lines: DataFrame, min_words: int) -> DataFrame:
    """document, pos, count: for each repeated line the shortest run of repeated lines that starts there and has
    min_words words, and the shortest that ends there."""
    by_pos = Window.partitionBy(*DOC).orderBy("pos")
    island = lines.withColumn("island", F.col("pos") - F.row_number().over(by_pos))
    inside = Window.partitionBy(*DOC, "island").orderBy("pos")
    before = island.withColumn("upto", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    final = F.lead("pos").over(inside).isNull()
    # boundaries between lines: one ahead of each line, and one after the last
    bounds = before.withColumn("ends", final).select(
        *DOC, "island",
        F.inline(F.when(
            F.col("ends"),
            F.array(
                F.struct(F.col("pos").alias("at"), (F.col("upto") - F.col("words")).alias("sum")),
                F.struct((F.col("pos") + 1).alias("at"), F.col("upto").alias("sum")),
            ),
        ).otherwise(F.array(F.struct(F.col("pos").alias("at"), (F.col("upto") - F.col("words")).alias("sum"))))),
    )
    nothing = F.lit(None).cast("int")
    events = bounds.select(
        *DOC, "island",
        F.inline(F.array(
            F.struct(F.col("sum").alias("x"), F.col("at").alias("bound"), nothing.alias("start"), nothing.alias("end")),
            F.struct((F.col("sum") + min_words).alias("x"), nothing.alias("bound"), F.col("at").alias("start"), nothing.alias("end")),
            F.struct((F.col("sum") - min_words).alias("x"), nothing.alias("bound"), nothing.alias("start"), F.col("at").alias("end")),
        )),
    )
    group = Window.partitionBy(*DOC, "island")
    falling = group.orderBy(F.col("x").desc(), F.col("bound").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    rising = group.orderBy(F.col("x"), F.col("bound").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = events.withColumn("next", F.min("bound").over(falling)).withColumn("previous", F.max("bound").over(rising))
    first = F.coalesce("start", F.when(F.col("end").isNotNull(), F.col("previous")))
    stop = F.coalesce("end", F.when(F.col("start").isNotNull(), F.col("next")))
    return (
        met.where("start is not null or end is not null")
        .select(*DOC, first.alias("pos"), (stop - first).alias("count")).where("count > 0").distinct()
    )


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """document (known, id, digest), start, stop: the lines that a later copy of a repeated run covers.

    Line numbers are doubled: a run of 2**k lines is named by the first place that has it, from the names of its
    halves, and only runs that repeat go on. These names are the intervals of the suffix array that have a common prefix of so
    many lines. A run of any count is two overlapping runs of 2**k lines. Of each place only the shortest
    runs with min_words words are looked up, one that starts and one that ends there: a longer run repeats exactly where these do,
    and together they cover every maximal repeated run.
    """
    lines = checkpointed(lines_of(docs))
    single = repeated(lines, ["line1", "line2"]).select(*DOC, "pos", "words", "name").distinct()
    single = checkpointed(single)
    windows = checkpointed(shortest_windows(single.select(*DOC, "pos", "words"), min_words))
    longest = windows.agg(F.max("count")).first()[0] or 0
    runs, levels, half = single.select(*DOC, "pos", "name"), [], 1
    while half <= longest:
        levels.append(runs.withColumn("level", F.lit(len(levels))))
        if 2 * half <= longest:
            runs = checkpointed(doubled(runs, half))
        half *= 2
    if not levels:
        return windows.select(*DOC, F.col("pos").alias("start"), F.col("pos").alias("stop")).limit(0)
    names = levels[0]
    for more in levels[1:]:
        names = names.unionByName(more)
    names = checkpointed(names)  # short plans: each of the following steps is planned on its own
    level = F.floor(F.log2(F.col("count") + 0.5)).cast("int")
    heads = windows.withColumn("level", level).withColumn("tail", F.col("pos") + F.col("count") - F.pow(F.lit(2.0), F.col("level")).cast("int"))
    met = heads.join(names.withColumnRenamed("name", "head"), [*DOC, "pos", "level"]).join(
        names.select(*DOC, "level", F.col("pos").alias("tail"), F.col("name").alias("next")), [*DOC, "tail", "level"]
    )
    met = checkpointed(met.select(*DOC, "pos", "count", "head", "next"))
    copies = repeated(met.select(*DOC, "pos", "count", "head", "next"), ["count", "head", "next"]).where(
        where_of() != F.col("name")
    )
    spans = checkpointed(copies.select(*DOC, F.col("pos").alias("start"), (F.col("pos") + F.col("count")).alias("stop")))
    by_start = Window.partitionBy(*DOC).orderBy("start", "stop")
    reached = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    joined = spans.withColumn("new", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    joined = joined.withColumn("part", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(*DOC, "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("part")


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with `text` without the later copies of repeated line runs, and n_lines, removed_lines beside it.

    Lines end at line feeds. A run of lines with min_words words or more that stands somewhere before, in documents
    of smaller doc_id or further up, is deleted; copies may overlap. Rows with the same doc_id and text are one
    document and keep the same lines. Null text stays null, with one empty line. Shorter repeats stay.
    """
    spans = later_copies(docs, min_words)
    cuts = checkpointed(spans.groupBy(*DOC).agg(F.collect_list(F.struct("start", "stop")).alias("__cuts")))
    renamed = cuts.select(*[F.col(c).alias(f"__{c}") for c in DOC], "__cuts")
    text = whole_text()
    names = docs.columns
    base = docs.withColumns({
        "__known": F.col("doc_id").isNotNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")),
        "__digest": F.xxhash64(text),
    })
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists(F.col("__cuts"), lambda c: (i >= c["start"]) & (i < c["stop"])))
    met = base.join(renamed, ["__known", "__id", "__digest"], "left")
    removed = F.aggregate("__cuts", F.lit(0), lambda total, c: total + c["stop"] - c["start"])
    return met.select(
        *[c for c in names if c not in ("text", "n_lines", "removed_lines")],
        F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("removed_lines"),
    )


def line_dedup_digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, n_lines, removed_lines, text_sha256 and bytes of what stays."""
    cleaned = drop_repeated_lines(docs.select("doc_id", "text"), min_words)
    text = whole_text()
    return cleaned.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "removed_lines",
        F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.octet_length(text).cast("long").alias("bytes"),
    )
