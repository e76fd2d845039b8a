"""Language model, secrets, toxicity, packing and pieces against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tests.llm.fixtures import documents, nothing, rows
from tidebar.llm.packing import pack, read_vocabulary
from tidebar.llm.pieces import decode_pieces, encode_pieces, pieces_digest, read_pieces
from tidebar.llm.ppm import lm_scores
from tidebar.llm.secrets import BASE, RULES, redact_secrets, secret_digest, terms, trigram_query
from tidebar.llm.toxicity import FtrlPlan, drop_toxic, toxicity_scores


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def plain_model(texts, order):
    seen = collections.defaultdict(collections.Counter)
    for text in texts:
        data = b"\xfe" * order + text.encode().lower() + b"\xff"
        for p in range(order, len(data)):
            for j in range(order + 1):
                seen[data[p - j : p]][data[p]] += 1

    def score(text):
        data, total = b"\xfe" * order + text.encode().lower() + b"\xff", 0.0
        for p in range(order, len(data)):
            out = set()
            for j in range(order, -1, -1):
                left = {s: n for s, n in seen.get(data[p - j : p], {}).items() if s not in out}
                if not left:
                    continue
                whole = 2 * sum(left.values())
                if data[p] in left:
                    total += math.log10((2 * left[data[p]] - 1) / whole)
                    break
                total += math.log10(len(left) / whole)
                out |= set(left)
            else:
                total -= math.log10(255 - len(seen[b""]))
        return total

    return score


@pytest.mark.parametrize("chunk", [20_000, 8 << 20])
def test_language_model(spark, chunk):
    data = [(r[0], r[1] or "") for r in rows() if len(r[1] or "") < 5000]
    df = documents(spark).where("coalesce(length(text), 0) < 5000")
    counts, order = collections.Counter(), 3
    for i, t in data:
        if not held(i):
            counts.update(t.encode().lower().split() + [None])
    total, kinds = sum(counts.values()), len(counts)
    model = plain_model([t for i, t in data if not held(i)], order)
    expected = []
    for i, t in data:
        tokens = t.encode().lower().split() + [None]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)
        expected.append((i is not None, i or 0, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), total, base, model(t)))
    got = [(r.doc_id is not None, r.doc_id or 0, *r[1:]) for r in lm_scores(df, order=order, chunk_bytes=chunk).collect()]
    assert len(got) == len(expected)
    for a, b in zip(sorted(got), sorted(expected)):
        assert a[:6] == b[:6]
        assert a[6] == pytest.approx(b[6], rel=1e-9) and a[7] == pytest.approx(b[7], rel=1e-5)


def test_language_model_is_a_distribution(spark):
    """The probabilities of all symbols after a context add up to 1."""
    from tidebar.llm.ppm import log_probabilities

    rng = random.Random(2)
    text = bytes(rng.choice(b"abcd") for _ in range(400))
    counts = collections.Counter(text[i : i + 4] for i in range(len(text) - 3))
    contexts = {g[:3] for g in counts} | {b"xyz", b"aab"}
    grams = np.array(sorted(int.from_bytes(c + bytes([s]), "big") for c in contexts for s in range(256) if s != 254), np.uint64)
    n = np.array([counts.get(int(g).to_bytes(4, "big"), 0) for g in grams], np.int64)
    pairs = np.bincount((grams & np.uint64(0xFFFF)).astype(np.int64), weights=n, minlength=1 << 16).astype(np.int64)
    p = 10 ** log_probabilities(grams, n, 3, pairs)
    assert np.allclose(np.add.reduceat(p, np.flatnonzero(np.diff(grams >> np.uint64(8), prepend=np.uint64(0)))), 1)


def plain_spans(text):
    found = []
    for n, rule in enumerate(RULES):
        for m in re.finditer(rule.pattern, text, re.ASCII):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), n, m.end()))
    return [(RULES[n].kind, s, e) for s, n, e in sorted(found)]


def test_secrets(spark):
    texts = ["é api_key='abcdef' APIKEY:abcde PassWord=short1 tokentoken=abcdefgh", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "f" * 23 + "g" + "f" * 24,
             "ghp_" + "a" * 40 + " xoxb-1234567890ab -----BEGIN RSA PRIVATE KEY-----", "paſſword = abcdefgh", None, "", "eyJabcdefgh.eyJabcdefgh.abcdefghi"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(documents(spark).select("doc_id", "text"))
    expected = collections.Counter()
    for i, text in [*enumerate(texts), *((r[0], r[1]) for r in rows())]:
        spans = plain_spans(text or "")
        line = lambda xs: ",".join(f"{k}:{s}:{e}" for k, s, e in xs)
        kinds = collections.Counter(k for k, _, _ in spans)
        base = [x for x in spans if x[0] in {r.kind for r in BASE}]
        expected[i, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(line(base).encode()).hexdigest(), line(spans)] += 1
    got = collections.Counter(map(tuple, secret_digest(df).collect()))
    assert got == expected
    assert secret_digest(nothing(spark)).count() == 0


def test_trigram_queries():
    assert trigram_query(r"[0-9a-f]+") is None
    assert trigram_query(r"a[bc]d+") == ("or", [b"abd", b"acd"]) or terms(trigram_query(r"a[bc]d+")) <= {b"abd", b"acd"}
    assert terms(trigram_query(r"(?i:secret)x?=")) >= {b"sec", b"ecr", b"cre", b"ret"}


def test_redaction(spark):
    df = documents(spark)
    got = redact_secrets(df)
    assert got.columns == df.columns and got.count() == df.count()
    left = [r for r in got.collect() if r.text and plain_spans(r.text)]
    assert not left
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.text is not None and r.n_chars is not None)


def toxic_tables(spark, count=600):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(count):
        bad = i % 4 == 0
        text = [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 40, 120]))]
        if bad:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["vile", "wretchedly", "scumbag"])
        docs.append((i, " ".join(text), 9))
        labels.append((i, int(bad), None))
    docs += [(count, None, 1), (count + 1, "", 1), (None, "vile scumbag vile", 2), (0, docs[0][1], 9)]
    labels += [(count, None, 1), (None, 1, 1), (1, 0, 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, toxic int"),
        spark.createDataFrame(labels, "doc_id long, toxic int, text int"), count,
    )


def test_toxicity(spark):
    docs, labels, count = toxic_tables(spark)
    got = toxicity_scores(docs, labels).collect()
    assert len(got) == docs.count()
    tests = [r for r in got if r.doc_id is not None and r.doc_id < count and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in tests) / len(tests)
    assert right > 0.95 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {count, count + 1}


def test_training_memory():
    """Beside its two tables of 2**bits numbers, training holds the rows' features and little else."""
    import tracemalloc

    from tidebar.llm.toxicity import train

    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(50)) for _ in range(200)]
    tracemalloc.start()
    index, w, _ = train(texts, [i % 2 for i in range(200)], FtrlPlan())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(index) == len(w) > 0 and (w != 0).all()
    assert peak < 16 * 2**22 + 45e6


def test_toxicity_without_labels(spark):
    docs, labels, _ = toxic_tables(spark, 20)
    assert {r.score for r in toxicity_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity_scores(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity_scores(docs, labels.where("toxic = 0")).collect()} == {0}


def test_held_out_labels_are_not_used(spark):
    docs, labels, _ = toxic_tables(spark, 200)
    from tidebar.llm.toxicity import held_out

    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    plan = FtrlPlan(bits=16)
    key = lambda df: sorted((r.doc_id or -1, r.score) for r in df.collect())
    assert key(toxicity_scores(docs, labels, plan)) == key(toxicity_scores(docs, flipped, plan))
    assert docs.where(held_out()).count()


def test_packing(spark):
    from tokenizers import Tokenizer

    vocabulary = read_vocabulary()
    plain = Tokenizer.from_str(vocabulary)
    longest = 64
    got = pack(documents(spark), vocabulary, longest).collect()
    texts = collections.Counter((r[0], tuple(plain.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in rows())
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    assert all(r.length == r.bucket == len(r.ids) and r.length & (r.length - 1) == 0 and r.length <= longest for r in got)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    # whole documents come back from the pieces; rows with equal ids and texts have equal pieces
    pieces = collections.defaultdict(collections.Counter)
    for r in got:
        pieces[r.doc_id][r.start, tuple(r.ids), r.doc_tokens] += 1
    for (i, ids), times in texts.items():
        at = 0
        while at < len(ids):
            size = next(s for s, x, n in ((len(x), x, n) for start, x, n in pieces[i] if start == at and n == len(ids)) if tuple(ids[at : at + s]) == x)
            assert pieces[i][at, ids[at : at + size], len(ids)] >= times
            at += size
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in texts.items())
    assert pack(nothing(spark), vocabulary).count() == 0


def plain_pieces(text, pieces):
    best, single = {}, {}
    for i, (piece, score, one) in enumerate(pieces):
        if one:
            single[piece[0]] = i, score
        elif piece and (piece not in best or score > best[piece][1]):
            best[piece] = i, score
    if not text:
        return [], 0.0
    data = b" " + text.encode()
    top, last = [0.0] + [None] * len(data), [None] * (len(data) + 1)
    for e in range(1, len(data) + 1):
        i, s = single[data[e - 1]]
        top[e], last[e] = top[e - 1] + s, (i, 1)
        for n in range(min(48, e), 0, -1):
            found = best.get(data[e - n : e])
            if found and top[e - n] + found[1] > top[e]:
                top[e], last[e] = top[e - n] + found[1], (found[0], n)
    ids, e = [], len(data)
    while e:
        ids.append(last[e][0])
        e -= last[e][1]
    return ids[::-1], top[-1]


def test_pieces(spark):
    pieces = read_pieces()
    rng = random.Random(3)
    odd = ["".join(rng.choice(" ab\n\té中▁t he<0x0A>") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts = [r[1] for r in rows() if len(r[1] or "") < 4000] + odd + ["z" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = encode_pieces(df, pieces)
    got = {r.doc_id: r for r in encoded.collect()}
    for i, text in enumerate(texts):
        ids, score = plain_pieces(text, pieces)
        assert got[i].ids == ids and got[i].score == score
    back = {r.doc_id: r.text for r in decode_pieces(encoded, pieces).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    digest = pieces_digest(documents(spark), pieces).collect()
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in digest) == collections.Counter(
        (r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows()
    )
    assert pieces_digest(nothing(spark), pieces).count() == 0


def test_words_are_pieces_of_several_bytes():
    """On the real model bytes stand only for characters without a piece of their own."""
    import pyarrow as pa

    from tidebar.llm.pieces import Automaton

    pieces = read_pieces()
    machine, single = Automaton(pieces), {i for i, (_, _, one) in enumerate(pieces) if one}
    own = {p.decode() for p, _, one in pieces if p and not one and len(p.decode()) == 1}
    assert all(c in own for p, _, one in pieces if not one for c in p.decode())
    texts = ["the house", "two  spaces and    four", "naïve été", "日本語\n😀 \u2581"]
    ids, offsets, scores = machine.encode(pa.array(texts))
    parts = [[pieces[i][0] for i in ids[a:b]] for a, b in zip(offsets, offsets[1:])]
    assert b"".join(parts[0]) == b" the house" and not set(ids[: offsets[1]]) & single and all(len(p) > 1 for p in parts[0])
    for text, a, b in zip(texts, offsets, offsets[1:]):
        assert b"".join(pieces[i][0] for i in ids[a:b] if i in single) == "".join(c for c in text if c not in own).encode()
    assert np.diff(offsets).tolist() == [len(x) for x in parts] and scores[0] == sum(pieces[i][1] for i in ids[: offsets[1]])


def test_private_keys_go_with_their_bodies(spark):
    body = "\n".join("MIIEow+/" + x * 56 for x in "gh")
    key = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    texts = [f"é {key} after", f"{key}\n{key}\nafter", f"before -----BEGIN PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----\n", "-----END PRIVATE KEY----- alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in redact_secrets(df).collect()}
    assert got == {0: "é [secret] after", 1: "[secret]\n[secret]\nafter", 2: "before [secret]", 3: texts[3]}


def test_redaction_sends_back_changed_texts_alone(spark, monkeypatch):
    import tidebar.llm.secrets as secrets

    sizes, find = [], secrets.find
    monkeypatch.setattr(secrets, "find", lambda block, rules: sizes.append(pc.sum(pc.binary_length(block)).as_py()) or find(block, rules))
    plain = "é plain words " * 40_000  # over half of a block
    texts = [plain, "é password=abcdefgh x", None, plain, "", plain + "AKIA" + "A" * 16]
    got = secrets.changed_texts(pa.array(texts, pa.string()), RULES, "[secret]").to_pylist()
    assert got == [None, "é [secret] x", None, None, None, plain + "[secret]"]
    assert len(sizes) > 2 and max(s or 0 for s in sizes) <= secrets.REDACTED_BYTES
    monkeypatch.undo()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in redact_secrets(df).collect()} == dict(enumerate(g or t for g, t in zip(got, texts)))


def test_packing_in_small_blocks(spark):
    vocabulary = read_vocabulary()
    df = documents(spark).coalesce(1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    whole, small = (collections.Counter(map(str, pack(df, vocabulary, word_block=n).select(names).collect())) for n in (4 << 20, 200))
    assert whole == small and whole


def test_words_met_again_stay_encoded(monkeypatch):
    from tidebar.llm import packing

    monkeypatch.setattr(packing, "KEPT_WORDS", 40)
    encoder = packing.WordEncoder(read_vocabulary(), 2)
    asked, encoded = collections.Counter(), encoder.encoded
    monkeypatch.setattr(encoder, "encoded", lambda words: asked.update(words) or encoded(words))
    letters = "abcdefghijklmnopqrst"
    texts = [" ".join(["often###"] * 2 + [f"rare{a}{b}" for b in letters]) for a in letters]
    for text in texts:
        ids, offsets = encoder.encode(pa.array([text, None]))
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [2, 2]
        assert offsets.tolist() == [0, len(ids) - 1, len(ids)] and len(encoder.numbers) <= 40
    # a word that came twice lasts while rare ones go, and marks are no part of it
    assert asked[b"often"] == asked[b"###"] == 1 and b"often###" not in asked and len(asked) == 402


def test_ids_of_odd_words():
    from tidebar.llm import packing

    encoder = packing.WordEncoder(read_vocabulary(), 2)
    assert encoder.plain is not encoder.tokenizer
    assert packing.plain_tokenizer(read_vocabulary().replace('"type":"NFC"', '"type":"NFKC"').replace('"type": "NFC"', '"type": "NFKC"')) is None
    draw, alphabet = random.Random(3), [*"abcéÉñßÿĀz AZ  \t\n.,#$%&*'\"()[]<>|=+~^`{}@-_/\\:;!?01", "'s", "'re", "<|endoftext|>", "́", "̸", "̇", "İ", "日本", "😀", "\x85"]
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 60))) for _ in range(1500)]
    for first in range(0, len(texts), 100):
        ids, offsets = encoder.encode(pa.array(texts[first : first + 100]))
        for k, text in enumerate(texts[first : first + 100]):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [2], text
