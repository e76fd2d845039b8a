"""Exact copies, near copies and repeated lines against plain versions."""

import collections
import hashlib
import random
import re

import xxhash

from tests.llm.fixtures import documents, nothing, rows
from tidebar.llm.components import components
from tidebar.llm.exact_dedup import dense_names, drop_exact_duplicates, exact_duplicates
from tidebar.llm.line_dedup import drop_repeated_lines
from tidebar.llm.simhash import drop_near_duplicates, links, near_duplicates, simhash, simhash_groups

import pytest

def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("block", [64, 4096])
def test_exact_duplicates(spark, block):
    groups = collections.defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    expected = collections.Counter()
    for text, ids in groups.items():
        best = max(ids, key=lambda i: (i is not None, i or 0))
        kept = False
        for i in ids:
            keep = i == best and not kept
            kept |= keep
            expected[i, best, len(ids), keep, sha(text)] += 1
    got = exact_duplicates(documents(spark), block).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert collections.Counter(map(tuple, got)) == expected


def test_exact_names_tell_texts_apart(spark):
    found = exact_duplicates(documents(spark), 64).select("level", "name", "text_sha256").distinct().collect()
    assert len({(r.level, r.name) for r in found}) == len({r.text_sha256 for r in found}) == len(found)


def test_dense_names_with_mixed_leads(spark):
    """Keys of one lead in several tasks: the work is done again with the keys as bounds."""
    df = spark.createDataFrame([(k % 5, i) for i, k in enumerate(list(range(200)) * 3)], "k int, i int").selectExpr("k", "i", "0 as lead")
    got = {(r.name, r.i % 5) for r in dense_names(df, ["k"], ["i"], ["i"], "lead").collect()}
    assert got == {(k, k) for k in range(5)}


def test_drop_exact_keeps_columns(spark):
    df = documents(spark)
    kept = drop_exact_duplicates(df, 256)
    assert kept.columns == df.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r[1] or "" for r in rows()})


def test_copies_of_nothing(spark):
    assert exact_duplicates(nothing(spark)).count() == 0
    assert simhash_groups(nothing(spark)).count() == 0
    assert near_duplicates(nothing(spark)).count() == 0
    assert drop_repeated_lines(nothing(spark)).count() == 0


def plain_simhash(text, width):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return {n: find(n) for n in nodes}


def test_simhash_groups(spark):
    prints = [(r[0], plain_simhash(r[1], 3)) for r in rows()]
    classes = roots({p for _, p in prints}, lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for i, p in prints:
        if i is not None:
            least[classes[p]] = min(least.get(classes[p], i), i)
    expected = collections.Counter((i, f"{p:016x}", least.get(classes[p])) for i, p in prints)
    assert collections.Counter(map(tuple, simhash_groups(documents(spark)).collect())) == expected


@pytest.mark.parametrize("pairwise", [1, 8, 10_000])
def test_links_keep_components(spark, pairwise):
    """Large index entries take the way over midpoints; the components are those of all pairs."""
    import random

    rng = random.Random(4)
    prints = set()
    for base in [rng.getrandbits(64) for _ in range(8)]:
        for _ in range(40):
            x = base
            for k in rng.sample(range(12), rng.randint(0, 6)):
                x ^= 1 << (5 * k)
            prints.add(x - (1 << 64) if x >> 63 else x)
    expected = roots(prints, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r.node: r.root for r in components(links(df, pairwise)).collect()}
    assert {p: got.get(p, p) for p in prints} == expected


def test_fewer_words_than_a_shingle():
    assert simhash(b"A b", 3) == simhash(b"a\tB ", 3) == xxhash.xxh64_intdigest(b"a b", 42).to_bytes(8, "big")
    assert simhash(b" \n", 3) == bytes(8)


def test_near_duplicates(spark):
    base = [f"t{i}" for i in range(300)]
    one = base[:150] + ["changed"] + base[151:]  # similarity 291 / 301
    far = [f"u{i}" for i in range(300)]
    texts = {1: base, 2: one, 3: far, 4: base[:100] + far[:200]}
    df = spark.createDataFrame([(i, " ".join(t), None) for i, t in texts.items()] + [(5, None, "x"), (6, "", "y"), (2, " ".join(one), "z")], "doc_id long, text string, node string")
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]


def test_near_duplicates_go_by_fingerprints(spark, monkeypatch):
    """The SimHashes of all texts pass the index over byte positions; what it links is joined, if alike enough."""
    from tidebar.llm import simhash as module

    rng, seen = random.Random(8), []

    def recorded(prints, *more):
        found = links(prints, *more)
        seen.append(({r.fp for r in prints.collect()}, found.count()))
        return found

    monkeypatch.setattr(module, "links", recorded)
    texts = []
    for k in range(4):
        base = [f"t{rng.getrandbits(40)}" for _ in range(1500)]
        texts += [" ".join(base), " ".join(base + ["more"]), " ".join(base[:400])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in drop_near_duplicates(df).orderBy("doc_id").collect()] == [i for i in range(12) if i % 3 != 1]
    prints = [module.print_of([module.distinct_shingles(t.encode(), 5)]) for t in texts]
    close = {(a, b) for b in prints for a in prints if a < b and (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() <= 2}
    assert close
    assert seen == [({int.from_bytes(x, signed=True) for x in prints}, len(close))]


def test_near_duplicates_are_those_of_all_pairs(spark):
    from tidebar.llm.simhash import distinct_shingles

    rng = random.Random(9)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(30)}" for _ in range(rng.choice([6, 9, 40, 150]))]
        for _ in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 50)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
            texts.append(" ".join(words[: len(words) - rng.randint(0, len(words) // 5)]))
    texts = sorted(set(texts)) + ["", " "]
    sets = [set(distinct_shingles(t.encode(), 5).tolist()) for t in texts]

    def alike(a, b):
        x, y = sets[a], sets[b]
        return len(x & y) >= 0.8 * len(x | y)

    expected = roots(set(range(len(texts))), alike)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.group_doc for r in near_duplicates(df).collect()} == expected


def counted(line):
    return len(re.findall(r"[^\x20\x09-\x0D]+", line))


def plain_lines(docs, least):
    seen, gone = set(), {}
    for key, lines in docs:
        cut = set()
        for a in range(len(lines)):
            total = 0
            for b in range(a + 1, len(lines) + 1):
                total += counted(lines[b - 1])
                if total >= least:
                    run = tuple(lines[a:b])
                    if run in seen:
                        cut.update(range(a, b))
                    seen.add(run)
        gone[key] = cut
    return gone


def test_repeated_lines(spark):
    digest = lambda t: (t or "")
    keyed = {}
    for r in rows():
        keyed.setdefault((r[0], digest(r[1])), r)
    df = documents(spark)
    # order of documents: null ids first, then ids, then the hash that the operator uses
    hashes = {(r.doc_id, r.t): r.h for r in df.selectExpr("doc_id", "coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()}
    order = sorted(keyed, key=lambda k: (k[0] is not None, k[0] or 0, hashes[k]))
    small = [(k, k[1].split("\n")) for k in order if len(k[1]) < 50_000]
    gone = plain_lines([x for x in small if len(x[1]) < 200], 50)
    got = drop_repeated_lines(df)
    assert [c for c in got.columns if c not in ("n_lines", "removed_lines")] == [c for c in df.columns if c != "text"] + ["text"]
    by_source = collections.defaultdict(list)
    for r in got.collect():
        by_source[r.doc_id].append(r.text or "")
    checked = 0
    for (i, text), cut in gone.items():
        stays = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in cut)
        assert stays in by_source[i]
        checked += len(cut)
    assert checked > 20


def test_words_are_runs_without_white_space(spark):
    """Words parted by tabs count, indentation does not."""
    tabs, code = "\t".join(f"t{i}" for i in range(80)), " " * 60 + "x"
    df = spark.createDataFrame([(1, tabs), (2, tabs + "\nend"), (3, f"{code}\n{code}\nq"), (4, f"{code}\n{code}\nr")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in drop_repeated_lines(df, 50).collect()}
    assert got == {1: tabs, 2: "end", 3: f"{code}\n{code}\nq", 4: f"{code}\n{code}\nr"}


def test_lines_that_repeat_within_a_text(spark):
    line = " ".join(f"k{i}" for i in range(30))
    df = spark.createDataFrame([(1, "\n".join([line] * 5 + ["end"])), (2, "short\n" + line), (3, "\n".join([line, line, "short"]))], "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in drop_repeated_lines(df, 50).collect()}
    assert got == {1: [line, "end"], 2: ["short", line], 3: ["short"]}


def edited(rng, text, share):
    """text with about that share of its words changed, in runs, so that shingle sets keep a similarity around 0.8."""
    out = list(text)
    for at in rng.sample(range(len(out)), max(1, round(share * len(out)))):
        out[at] = f"n{rng.getrandbits(40)}"
    return out


def groups_by_brute_force(texts, least=0.8):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in texts.items()}

    def near(a, b):
        whole = len(sets[a] | sets[b])
        return not whole or len(sets[a] & sets[b]) / whole >= least

    return roots(sets, near), sets


def assert_groups(spark, texts, **more):
    expected, sets = groups_by_brute_force(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.group_doc for r in near_duplicates(df, **more).collect()} == expected
    return expected, sets


def test_near_duplicates_at_the_bound(spark):
    """Long and short texts whose similarity is close to 0.8, against all pairs."""
    import random

    rng, texts = random.Random(5), {}
    for size in [5, 8, 9, 12, 20, 60, 150, 300, 700]:
        for _ in range(6):
            base = [f"w{rng.getrandbits(30)}" for _ in range(size)]
            for other in [base, base[:-1], base[1:], base + ["more"], *(edited(rng, base, s) for s in (0.01, 0.02, 0.023, 0.026))]:
                texts[len(texts)] = " ".join(other)
    expected, sets = assert_groups(spark, texts)
    values = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in range(a // 8 * 8, a)]
    assert sum(0.8 <= x < 0.85 for x in values) > 50 and sum(0.75 <= x < 0.8 for x in values) > 20


def test_near_duplicates_in_large_entries(spark):
    """Hundreds of texts in each entry: a common passage, a large group of near copies and pairs that meet only there."""
    import random

    rng, texts = random.Random(8), {}
    common = [f"c{i}" for i in range(30)]
    for _ in range(120):
        own = [f"o{rng.getrandbits(40)}" for _ in range(8)]  # unlike by the eight, similar to the copy with one more
        texts[len(texts)] = " ".join(common + own)
        texts[len(texts)] = " ".join(common + own + ["more"])
    base = [f"b{i}" for i in range(120)]
    for _ in range(200):
        texts[len(texts)] = " ".join(edited(rng, base, 0.02))
    for _ in range(80):  # from the same text, but outside or at the edge of the group
        texts[len(texts)] = " ".join(edited(rng, base, 0.04))
    ids = list(texts)
    rng.shuffle(ids)
    texts = dict(zip(ids, texts.values()))
    for rounds in (1, 3):
        expected, _ = assert_groups(spark, texts, rounds=rounds)
    assert 121 <= len(set(expected.values())) < 250


def test_near_duplicates_count_a_repeated_passage_once(spark):
    import random

    rng = random.Random(9)
    text = [f"w{rng.getrandbits(30)}" for _ in range(200)]
    short = [f"s{rng.getrandbits(30)}" for _ in range(60)]
    texts = {1: " ".join(text), 2: " ".join(text[:50] + text[40:50] * 50 + text[50:]), 3: " ".join(short), 4: " ".join(short + short[-6:] * 50)}
    expected, _ = assert_groups(spark, texts)
    assert expected == {1: 1, 2: 1, 3: 3, 4: 3}


def test_near_duplicates_whose_numbers_clash(spark):
    """Two digits of the digest number 300 texts, so most share theirs with another text."""
    import random

    rng, texts = random.Random(12), {}
    for _ in range(150):
        base = [f"w{rng.getrandbits(30)}" for _ in range(rng.choice([20, 90]))]
        texts[len(texts)] = " ".join(base)
        texts[len(texts)] = " ".join(edited(rng, base, rng.choice([0.01, 0.03, 0.3])))
    expected, _ = assert_groups(spark, texts, digits=2)
    assert 150 < len(set(expected.values())) < 300


def test_wide_sketches_never_rule_out_similar_sets(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tidebar.llm.simhash import likely_by_wide, parity

    rng, rows_, want = np.random.default_rng(3), [], set()
    for k in range(120):
        size, other = int(rng.integers(20, 3000)), float(rng.choice([0.0, 0.05, 0.1, 0.12, 0.3]))
        a = rng.integers(0, 1 << 63, size).astype(np.uint64)
        b = np.concatenate((a[: int(size * (1 - other))], rng.integers(0, 1 << 63, int(size * other)).astype(np.uint64)))
        longs = lambda x: max(8, 1 << (len(x) // 32).bit_length())
        rows_.append((k, len(a), len(b), parity(a, longs(a)).tolist(), parity(b, longs(b) * (2 if k % 3 == 0 else 1)).tolist()))
        common = len(set(a.tolist()) & set(b.tolist()))
        if common / (len(a) + len(b) - common) >= 0.8:
            want.add(k)
    df = spark.createDataFrame(rows_, "k int, size_a int, size_b int, wide_a array<long>, wide_b array<long>")
    got = {r.k for r in likely_by_wide(df, 0.8).collect()}
    assert want <= got and len(got) < 110


def test_texts_that_meet_by_a_few_shingles_are_no_pairs(spark, monkeypatch):
    """Long unlike texts with one rare passage: sketches of 512 places cannot tell them apart, the entries shared do."""
    from tidebar.llm import simhash

    rng = random.Random(8)
    own = lambda n: " ".join(f"x{rng.randrange(10**9)}" for _ in range(n))
    texts = [f"{own(700)} one rare passage of six words {own(700)}" for _ in range(40)]
    base = own(1400).split()
    copies = [" ".join(base[: 30 * i] + base[30 * i + 60 :]) for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string")
    given, similar = [], simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda d, n, s, pairs, *a: given.append(pairs.count()) or similar(d, n, s, pairs, *a))
    got = {r.doc_id: r.group_doc for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: min(i, 40) for i in range(46)}
    assert sum(given) <= 60


def test_similar_sets_share_the_entries_asked(spark):
    from pyspark.sql import functions as F

    from tidebar.llm.simhash import asked, distinct_shingles, sketches

    rng, texts = random.Random(9), []
    for n in (5, 8, 30, 90, 200, 450, 1100):
        base = [f"y{rng.randrange(10**9)}" for _ in range(n)]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randrange(1 + n // 60)):
                words[rng.randrange(n)] = "changed"
            texts.append(" ".join(words[rng.randrange(1 + n // 20) : n - rng.randrange(1 + n // 20)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = docs.select("text", sketches(docs, 5, 0.8).alias("s")).select("text", "s.prefix", asked(F.col("s.size"), 0.8).alias("asked")).collect()
    sets = [set(distinct_shingles(r.text.encode(), 5).tolist()) for r in found]
    pairs = 0
    for i, x in enumerate(found):
        for j, y in enumerate(found[:i]):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                pairs += 1
                assert len(set(x.prefix) & set(y.prefix)) >= min(x.asked, y.asked)
    assert pairs > 40


def test_few_rows_lie_in_few_partitions(spark):
    from tidebar.llm.common import few

    assert [few(spark.range(0, 1000, 1, 50), n).rdd.getNumPartitions() for n in (0, 1000, 600_000, 10**9)] == [1, 1, 4, 50]


def test_short_lists_of_similar_pairs_are_few_tasks(spark, monkeypatch):
    from tidebar.llm import simhash as module

    parts = []
    monkeypatch.setattr(module, "components", lambda edges: parts.append(edges.rdd.getNumPartitions()) or components(edges))
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:30], *(f"x{k}y{i}" for i in range(5 * (k % 3)))]) for k in range(12)] + [" ".join(words)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = near_duplicates(df, rounds=0).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(texts) and sum(not r.kept for r in got) >= 4
    # a list of some pairs is one partition, however many tasks wrote it
    assert len(parts) > 1 and all(n <= k for k, n in enumerate(parts, 1)), parts
