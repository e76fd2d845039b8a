"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio. DataFrame functions alone."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import checkpointed, whole_text

#: White space between words, and the symbols that are counted.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", "#*$%&|<>"
#: A token is a run of ASCII letters, ASCII digits and all characters beyond ASCII, or a run of ASCII marks.
TOKEN = r"[0-9A-Za-z\x80-\x{10FFFF}]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"
#: Weights are whole numbers of this part of a nat, so sums do not depend on their order.
UNIT = 1_000_000


@dataclass(frozen=True)
class RatioPlan:
    """buckets: places of the hashed n-grams; the two multinomials go over the driver as a table of that size. sample: labelled
    ids of each kind that target and threshold look at, at most; None: all of them. The raw side counts all documents. cells:
    words of 64 bits at most in the table of labelled ids that is broadcast."""

    buckets: int = 1 << 14
    sample: int | None = None
    width: int = 5
    least_words: int = 10
    most_repeated: int = 20
    cells: int = 1 << 20


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def line_repeats(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.size(lines) - F.size(F.array_distinct(lines))


def pairs_up(first: Column, last: Column, make) -> Column:
    """make(i) for i from first to last; empty if there is none."""
    return F.when(last >= first, F.transform(F.sequence(first, last), make)).otherwise(F.array().cast("array<long>"))


def with_counts(rows: DataFrame, plan: RatioPlan) -> DataFrame:
    """The columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed from the column `body`.

    A window of `width` words is known by a 64-bit hash. Windows sorted by hash show which occur twice; the words that
    these cover are counted in order of place. Each step is a column of its own, so that it is worked out once.
    """
    width = plan.width
    body = bare = F.col("body")
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    split = rows.withColumns({
        "n_symbols": (F.octet_length(body) - F.octet_length(bare)).cast("long"),
        "n_dup_lines": line_repeats(body).cast("long"), "words": words_of(body),
    }).drop("body")
    hashed = split.withColumns({
        "n_words": F.size("words").cast("long"), "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "hashes": F.transform("words", lambda w: F.xxhash64(w)),
    }).drop("words")
    at = lambda i: [F.get("hashes", i + k) for k in range(width)]
    windows = hashed.withColumn("windows", pairs_up(F.lit(0), F.size("hashes") - width, lambda i: F.xxhash64(*at(i)))).drop("hashes")
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    unlike = F.size(F.array_distinct("windows")) == F.size("windows")
    ordered = windows.withColumn("ordered", F.when(~unlike, F.array_sort(placed))).drop("windows")
    twice = lambda s, k: (s["h"] == F.get("ordered", k - 1)["h"]) | (s["h"] == F.get("ordered", k + 1)["h"])
    places = F.array_sort(F.transform(F.filter("ordered", lambda s, k: F.coalesce(twice(s, k), F.lit(False))), lambda s: s["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    counted = ordered.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("ordered")
    short = F.col("n_words") < plan.least_words
    return counted.withColumn("base_failed", short | (100 * F.col("n_repeat_words") > plan.most_repeated * F.col("n_words")))


def with_grams(rows: DataFrame, plan: RatioPlan) -> DataFrame:
    """The column `grams`: hashes of all tokens and pairs of neighbouring tokens of `body`, in lower case."""
    hashed = rows.withColumn("tokens", F.transform(F.regexp_extract_all(F.lower("body"), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t)))
    two = pairs_up(F.lit(0), F.size("tokens") - 2, lambda i: F.xxhash64(F.get("tokens", i), F.get("tokens", i + 1)))
    return hashed.withColumn("grams", F.concat("tokens", two)).drop("tokens")


def bucket_of(gram: Column, plan: RatioPlan) -> Column:
    return F.pmod(gram, F.lit(plan.buckets).cast("long")).cast("int")


def labelled_ids(labels: DataFrame, quality: int, plan: RatioPlan) -> DataFrame:
    """Distinct ids with this label: all, or the first `sample` in a fixed order that does not follow the ids."""
    ids = labels.where(F.col("quality") == quality).select(F.col("doc_id").cast("long").alias("known_id")).where("known_id is not null")
    ids = ids.distinct()
    return ids if plan.sample is None else ids.orderBy(F.xxhash64("known_id"), "known_id").limit(plan.sample)


def bodies(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("body"))


def cell_and_bits(name: str, plan: RatioPlan) -> tuple[Column, Column]:
    """The cell of an id, null for a null id, and the four bits (or fewer) that it has there."""
    mixed = F.xxhash64(name)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(mixed, 40 + 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]
    whole = bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])
    return F.when(F.col(name).isNotNull(), F.pmod(mixed, F.lit(plan.cells).cast("long"))), whole


def cells_of(ids: DataFrame, name: str, plan: RatioPlan) -> DataFrame:
    """cell, held: the bits of all ids of a cell; `cells` rows at most, whatever the input."""
    cell, bits = cell_and_bits(name, plan)
    return ids.select(cell.alias("cell"), bits.alias("bits")).groupBy("cell").agg(F.bit_or("bits").alias("held"))


def with_likely(rows: DataFrame, cells: DataFrame, plan: RatioPlan) -> DataFrame:
    """The column `likely`: true for all rows whose doc_id is in the cells, and by chance for others."""
    cell, bits = cell_and_bits("doc_id", plan)
    # the hint is safe: the table has a fixed size
    met = rows.withColumns({"at": cell, "bits": bits}).join(F.broadcast(cells), F.col("at") == F.col("cell"), "left")
    return met.withColumn("likely", F.coalesce(F.col("held").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False))).drop("at", "bits", "cell", "held")


def gram_counts(rows: DataFrame, plan: RatioPlan) -> dict[int, tuple[int, int]]:
    """For each bucket the grams of `body` there in all rows, and in those that are `likely`."""
    # the outer form, since the plain one repeats the whole expression in a filter of its own
    grams = with_grams(rows, plan).select("likely", F.explode_outer("grams").alias("gram"))
    counts = grams.where("gram is not null").groupBy(bucket_of(F.col("gram"), plan).alias("bucket")).agg(F.count("*").alias("raw"), F.count_if("likely").alias("target"))
    return {r["bucket"]: (r["raw"], r["target"]) for r in counts.collect()}  # `buckets` rows at most, whatever the input


def bucket_weights(docs: DataFrame, trusted: DataFrame, plan: RatioPlan) -> list[int]:
    """log of target over raw share for each bucket, in units; all documents are counted on the raw side. Both have one added a bucket.

    Texts are not shuffled to meet their labels: one pass counts, as target, the documents that the cells of the trusted ids
    let through. Which of these are not trusted is found by ids alone; the grams of those few, exactly joined, are taken off.
    """
    cells = checkpointed(cells_of(trusted, "known_id", plan))
    found = gram_counts(with_likely(docs, cells, plan), plan)
    seen = with_likely(docs.select("doc_id"), cells, plan).where("likely").select(F.col("doc_id").alias("false_id")).distinct()
    false = checkpointed(seen.join(trusted, F.col("false_id") == F.col("known_id"), "left_anti"))
    wrong = {}
    if not false.isEmpty():
        near = with_likely(docs, cells_of(false, "false_id", plan), plan).where("likely")
        wrong = gram_counts(near.join(false, F.col("doc_id") == F.col("false_id"), "left_semi"), plan)
    both = []
    for k in range(plan.buckets):
        raw, target = found.get(k, (0, 0))
        both.append((raw + 1, target - wrong.get(k, (0, 0))[1] + 1))
    all_raw, all_target = map(sum, zip(*both))
    return [round(UNIT * (math.log(target / all_target) - math.log(raw / all_raw))) for raw, target in both]


def median_score(scored: DataFrame, ids: DataFrame) -> float | None:
    return median(scored.where(~F.col("base_failed")).join(ids, F.col("doc_id") == F.col("known_id"), "left_semi").select("score"))


def median(values: DataFrame) -> float | None:
    """The exact median of the column `score`, null without rows. Distinct scores with their counts lie in ranges of one
    partition each; a count a range reaches the driver, and only the middle's range is looked at row by row."""
    counts = values.groupBy("score").agg(F.count("*").alias("n")).orderBy("score")
    counts = checkpointed(counts.withColumn("part", F.spark_partition_id()))
    sizes = counts.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    total = sum(r["n"] for r in sizes)
    if not total:
        return None

    def at(place: int) -> float:
        before = 0
        for part, n in sizes:
            if place < before + n:
                break
            before += n
        upto = F.sum("n").over(Window.partitionBy("part").orderBy("score"))
        inside = counts.where(F.col("part") == part).withColumn("upto", upto)
        return inside.where(F.col("upto") > place - before).agg(F.min("score")).first()[0]

    low = at((total - 1) // 2)
    return low if total % 2 else (low + at(total // 2)) / 2


def quality_rules(docs: DataFrame, labels: DataFrame, plan: RatioPlan = RatioPlan()) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_grams, ratio_units, score.

    score is the mean, over all hashed tokens and pairs of tokens of the text, of the log of their share in the trusted target over that in the
    raw corpus; ratio_units is the sum as a whole number of millionths. kept: not base_failed, and the score is at least the
    threshold: half-way between the median score of the trusted documents and that of documents labelled as bad, those
    that are base_failed left out of both.

    Null and empty texts have no words and are base_failed; texts without a token score 0. Repeated rows stand each for themselves, and so
    do rows of one id; a label holds for all rows of its id, and an id labelled both ways counts on both sides. Null ids and labels
    say nothing. Without trusted or without bad documents no score rejects. Ties with the threshold are kept. An empty table gives no rows. Other columns of either table play no part. A very long text is one
    row of some arrays of 8 bytes a word. Two passes over the texts, which are not shuffled; where cells let ids through by chance, a third,
    which shuffles the texts of those alone.
    """
    texts = bodies(docs)
    trusted = checkpointed(labelled_ids(labels, 1, plan))
    weights = F.split(F.lit(",".join(map(str, bucket_weights(texts, trusted, plan)))), ",").cast("array<long>")
    measured = with_counts(with_grams(texts, plan), plan)
    units = F.aggregate("grams", F.lit(0).cast("long"), lambda a, g: a + F.get(weights, bucket_of(g, plan)))
    scored = checkpointed(
        measured.withColumns({"n_grams": F.size("grams").cast("long"), "ratio_units": units}).drop("grams")
        .withColumn("score", F.when(F.col("n_grams") == 0, 0.0).otherwise(F.col("ratio_units") / F.col("n_grams") / UNIT))
    )
    middle = [median_score(scored, ids) for ids in (trusted, labelled_ids(labels, 0, plan))]
    passes = F.lit(True) if None in middle else F.col("score") >= sum(middle) / 2
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & passes).alias("kept"), "n_grams", "ratio_units", "score",
    )
