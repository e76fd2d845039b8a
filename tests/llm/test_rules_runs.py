"""Quality rules and periodic runs against plain versions."""

import hashlib
import math
import random
import re
import statistics
import zlib

import numpy as np
import pytest

from tests.llm.fixtures import documents, nothing, rows
from tidebar.llm import recompression
from tidebar.llm.quality_rules import RatioPlan, quality_rules
from tidebar.llm.recompression import Grammar, block_rows, periodic_digest, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, covered = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(j for i in places for j in range(i, i + 5))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), (
        n < 10 or 100 * len(covered) > 20 * n
    )


LABELS = "doc_id long, quality int, toxic int, row long, words int, body string, known_id long"


def labels(spark):
    found = [(i, int(i % 5 > 0), 0, 1, 2, "x", 3) for i in range(60)] + [(None, 1, 0, 1, 2, "x", 3), (7, None, 0, 1, 2, "x", 3), (5000, 1, 0, 1, 2, "x", 3)]
    return spark.createDataFrame(found, LABELS)


def test_counts_of_quality_rules(spark):
    extra = [(2000, "a  b\tc d e f a b c d e x y", None), (2001, "one two three four five six seven eight nine ten # <&>\nq\nq\n \n \nq", None)]
    docs = documents(spark)
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"), allowMissingColumns=True)
    got = quality_rules(docs, labels(spark)).collect()
    want = sorted((repr(i), *plain_counts(t)) for i, t in [r[:2] for r in rows()] + [x[:2] for x in extra])
    assert sorted((repr(r[0]), *r[1:7]) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_ratio_follows_the_counts(spark):
    """Scores and verdicts worked out again from the buckets that Spark's hash gives."""
    from pyspark.sql import functions as F

    from tidebar.llm.quality_rules import bodies, bucket_of, labelled_ids, with_grams

    plan = RatioPlan(buckets=512, sample=30)
    docs = documents(spark)
    good, bad = ({r[0] for r in labelled_ids(labels(spark), q, plan).collect()} for q in (1, 0))
    assert len(good) == 30 and len(bad) == 12
    found = with_grams(bodies(docs), plan).select("doc_id", F.transform("grams", lambda g: bucket_of(g, plan)).alias("grams")).collect()
    raw, target = [1] * plan.buckets, [1] * plan.buckets
    for r in found:
        for g in r.grams:
            raw[g] += 1
            target[g] += r.doc_id in good
    weights = [round(1e6 * (math.log(t / sum(target)) - math.log(r / sum(raw)))) for t, r in zip(target, raw)]
    want = sorted((repr(r.doc_id), len(r.grams), sum(weights[g] for g in r.grams)) for r in found)
    got = quality_rules(docs, labels(spark), plan).collect()
    assert sorted((repr(r.doc_id), r.n_grams, r.ratio_units) for r in got) == want
    cut = sum(statistics.median(r.score for r in got if r.doc_id in ids and not r.base_failed) for ids in (good, bad)) / 2
    assert all(r.kept == (not r.base_failed and r.score >= cut) for r in got)


def test_junk_is_told_from_prose(spark):
    rng = random.Random(3)
    prose = [(i, " ".join(rng.choice(["the", "of", "house", "garden", "sea"]) + "abcdefgh"[rng.randrange(8)] for _ in range(60))) for i in range(80)]
    junk = [(100 + i, " ".join(f"q{rng.randrange(900)}$$$" for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame(prose + junk, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1) for i in range(40)] + [(i, 0) for i in range(100, 120)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality_rules(docs, marks).where("kept").collect()}
    assert kept == {i for i, _ in prose}


def test_all_labels_count(spark):
    """The registered plan looks at every labelled document, also beyond 20,000."""
    from tidebar.llm.quality_rules import labelled_ids

    count = 20_500
    docs = spark.range(2 * count).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 10 + id % 7), i -> concat('w', (id * i) % 97))) as text")
    marks = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    assert [labelled_ids(marks, q, RatioPlan()).count() for q in (0, 1)] == [count, count]
    got = quality_rules(docs, marks).collect()
    cut = sum(statistics.median(r.score for r in got if r.doc_id % 2 == q and not r.base_failed) for q in (0, 1)) / 2
    assert all(r.kept == (not r.base_failed and r.score >= cut) for r in got)


@pytest.mark.parametrize("cells", [1, 8, 1 << 20])
def test_texts_stay_where_they_are(spark, cells):
    """Labels too many to broadcast do not shuffle the texts, and ids that the cells let through by chance change nothing."""
    from pyspark.sql import functions as F

    from tidebar.llm.quality_rules import bodies, bucket_of, bucket_weights, cells_of, with_grams, with_likely

    plan = RatioPlan(buckets=256, cells=cells)
    docs = bodies(documents(spark))
    docs = docs.unionByName(docs.where("doc_id < 9"))
    trusted = spark.createDataFrame([(i,) for i in (*range(0, 60, 7), 1002, 1005, 1007, 9999)], "known_id long")
    ids = {r[0] for r in trusted.collect()}
    raw, target = [1] * plan.buckets, [1] * plan.buckets
    for r in with_grams(docs, plan).withColumn("grams", F.transform("grams", lambda g: bucket_of(g, plan))).collect():
        for g in r.grams:
            raw[g] += 1
            target[g] += r.doc_id in ids
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan_of = with_likely(docs, cells_of(trusted, "known_id", plan), plan)._jdf.queryExecution().executedPlan().toString()
        got = bucket_weights(docs, trusted, plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan_of and "BroadcastHashJoin" in plan_of
    assert got == [round(1e6 * (math.log(t / sum(target)) - math.log(r / sum(raw)))) for t, r in zip(target, raw)]


@pytest.mark.parametrize("count", [0, 1, 2, 999, 1000])
def test_median(spark, count):
    from tidebar.llm.quality_rules import median

    rng = random.Random(count)
    values = [rng.choice([0.0, rng.uniform(-2, 2)]) for _ in range(count)]
    df = spark.createDataFrame([(x,) for x in values], "score double").repartition(5)
    assert median(df) == (statistics.median(values) if values else None)


def test_rules_without_labels_or_rows(spark):
    assert quality_rules(nothing(spark), labels(spark)).count() == 0
    got = quality_rules(documents(spark), labels(spark).where("false")).collect()
    assert len(got) == len(rows()) and all(r.kept != r.base_failed for r in got)


def plain_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(24, 3 * q):
                out.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def periodic(rng, n, kinds):
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 10:
            a, p, size = rng.randrange(n), rng.randrange(1, 15), rng.randrange(20, 120)
            base = [rng.randrange(kinds) for _ in range(p)]
            w[a : a + size] = [base[j % p] for j in range(size)]
    return w


@pytest.mark.parametrize("grid", [50, 1 << 20])
def test_all_runs_are_found(grid, monkeypatch):
    monkeypatch.setattr(recompression, "GRID", grid)
    rng = random.Random(5)
    for _ in range(150):
        docs = [periodic(rng, rng.choice([0, 1, 5, 30, 100, 300]), rng.choice([1, 2, 3, 5, 50])) for _ in range(rng.randrange(1, 6))]
        found = [[] for _ in docs]
        got = periodic_runs(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs], np.int64))
        for d, s, n, q in zip(*(x.tolist() for x in got)):
            found[d].append((s, n, q))
        assert [sorted(x) for x in found] == [plain_runs(d) for d in docs]


def test_common_parts_by_grammar(monkeypatch):
    monkeypatch.setattr(recompression, "TOP", 1)
    rng = random.Random(2)
    for _ in range(200):
        w = np.array([-1] + [rng.randrange(2) for _ in range(rng.randrange(4, 60))] + [-2])
        pairs = np.array([(a, b) for a in range(1, len(w) - 1) for b in range(a + 1, len(w))])
        got = Grammar(w).common(pairs[:, 0], pairs[:, 1])
        for (a, b), k in zip(pairs.tolist(), got.tolist()):
            assert (w[a : a + k] == w[b : b + k]).all() and w[a + k] != w[b + k]


def plain_digest(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
        n, n - len(dropped),
    )


def test_periodic_digest(spark):
    rng = random.Random(8)
    extra = [(3000 + i, "  ".join(f"é{x}" for x in periodic(rng, rng.choice([40, 200]), 4))) for i in range(60)]
    extra += [(4000, "same " * 20_000), (4001, "a b\tc\n" * 8), (4002, "a b\tc\n" * 7)]
    docs = documents(spark).select("doc_id", "text", "lang", "size", "row").unionByName(
        spark.createDataFrame([(i, t, None, 1, 1) for i, t in extra], "doc_id long, text string, lang string, size int, row long")
    )
    got = sorted(map(tuple, periodic_digest(docs).collect()), key=repr)
    brief = [r for r in [x[:2] for x in rows()] + extra if len(r[1] or "") < 10_000]
    want = {repr(plain_digest(*r)) for r in brief}
    assert want <= {repr(r) for r in got} and len(got) == len(rows()) + len(extra)
    long = next(r for r in got if r[0] == 4000)
    assert long[1] == 1 and long[3] in (20_000, ) and long[4] == 1 and long[9] == 1
    assert periodic_digest(nothing(spark)).count() == 0


def test_rows_without_words():
    import pyarrow as pa

    assert [r[1] for r in block_rows([10, None], pa.array(["", " \n"]))] == [0, 0]
