"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, no rows and
clashing columns, against plain versions."""

import functools
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.llm import content_dedup, host_quality, lm_score, mixing, near_dup, packing, sharding, token_store, tokens, toxicity, url_rules

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, __x string"


def doc(i, text, lang="en", source="s0"):
    return (i, text, lang, source, None if text is None else len(text), True, "x")


def base_rows():
    rng = random.Random(3)
    words = [rng.choice("bcdfgl") + rng.choice("aeiou") * rng.randint(1, 2) + rng.choice(["", "n", "st"]) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [doc(k, line(rng.randint(5, 90)).capitalize() + ".", source=f"s{k % 4}") for k in range(1, 60)]
    body = line(120)
    rows += [doc(100 + k, body) for k in range(3)]  # copies
    near = body.split()
    rows += [doc(110 + k, " ".join([*near[: 40 + 9 * k], f"new{k}", *near[41 + 9 * k :]])) for k in range(4)]  # near copies
    rows += [doc(200, ""), doc(201, None), doc(202, "   \n\t "), doc(203, "one"), doc(204, "One"), doc(205, None, None, None)]
    rows += [doc(None, "no id here"), doc(None, None), doc(7, "an id again"), doc(203, "one")]
    rows += [doc(300, line(9000)), doc(301, "é\u00a0ü ß\u3000漢字 İ 'll don't <|endoftext|> \x1c x\r\n y")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(base_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1, k % 9 == 0) for k in range(1, 60)] + [(999, 1, True)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def ids_of(name, text, end):
    t = library(name)
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    e = tokens.Encoder(P.path(name))
    plain = lambda x: np.array(ids_of(name, x, 0)[:-1], "<u4").tobytes()
    rng = random.Random(5)
    parts = [*"aAbZé ß01.,'’! \n\t\r\xa0\u3000\x1c\x85İΣσ", "'s", " 'll", "<|endoftext|>", "<|startoftext|>", "<|endof", "漢字", "한", "!!", "|", "  ", "the", "ing"]
    for _ in range(1500):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert e.encode(x) == plain(x), repr(x)
    special = "<|endoftext|>"
    for x in (special + " a b", "a " + special + " b", "a b" + special, special, f"a{special}b {special}{special}", special.upper() + " x", "<|startoftext|>word"):
        assert e.encode(x) == plain(x), repr(x)
    assert {"byte_bpe_50k.json": 50256, "word_bpe_49k.json": 49407}[name] in np.frombuffer(e.encode(f"x {special} y"), "<u4")
    tokens_, tokens.SEGMENT = tokens.SEGMENT, 50
    try:
        for text in ("word, another word. " * 40 + "é" * 120, ("word " + "a" * 43 + special + " next " + special) * 9):
            assert e.encode(text) == plain(text)
    finally:
        tokens.SEGMENT = tokens_
    assert [b for _, b in e.encode_each([(1, "a b"), (2, None), (3, "c")])] == [plain(x) for x in ("a b", "", "c")]


def check_pieces(rows, docs, capacity, end):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    want = Counter()
    for r in docs.collect():
        ids = ids_of("word_bpe_49k.json", r.text, end)
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want[r.doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(by)


def test_packing(docs, empty):
    path = P.path("word_bpe_49k.json")
    rows = packing.pack_documents(docs, path, 1, 512, partitions=2).collect()
    used = check_pieces(rows, docs, 512, 1)
    assert used <= math.ceil(sum(r.length for r in rows) / 512) + 2
    assert packing.pack_documents(empty, path).count() == 0
    few = docs.filter("doc_id < 20 AND doc_id <> 7").select("doc_id", "text")
    placed = packing.pack_documents(few, path, 1, 128)
    seqs = {r.sequence_id: r for r in packing.sequences(few, placed, path, 1, 128).collect()}
    ids = {r.doc_id: ids_of("word_bpe_49k.json", r.text, 1) for r in few.collect()}
    for r in placed.collect():
        got = np.frombuffer(bytes(seqs[r.sequence_id].ids), "<u4")[r.offset : r.offset + r.length].tolist()
        assert got == ids[r.doc_id][r.start : r.start + r.length]


def test_sum_of_squares_rule():
    """Against a plain version that recomputes the whole sum for each choice."""
    rng = random.Random(1)
    m, open_ = packing.SumOfSquares(30), {}
    for _ in range(200):
        size = rng.randint(1, 30)
        count = Counter(open_.values())
        total = lambda c: sum(v * v for g, v in c.items() if g)
        best = {}
        for gap in [*count, 30]:
            if gap >= size:
                c = count.copy()
                if gap < 30 or count[30]:
                    c[gap] -= gap in count
                c[gap - size] += 1
                best[gap] = total(c)
        seq, offset = m.place(size)
        assert best[30 - offset] == min(best.values())
        open_[seq] = 30 - offset - size
        open_ = {s: g for s, g in open_.items() if g}


def plain_packing(sizes, capacity):
    """The rule and the repair step, with the whole sum computed anew for each choice."""

    def place(order, may_open):
        gaps, at = {}, {}
        for k in order:
            best = None
            count = Counter(g for g in gaps.values() if g)
            total = sum(v * v for v in count.values())
            fitting = sorted({g for g in gaps.values() if g >= sizes[k]})
            for g in [*fitting, *([capacity] if may_open or not fitting else [])]:
                after = count.copy()
                if g < capacity:
                    after[g] -= 1
                if g > sizes[k]:
                    after[g - sizes[k]] += 1
                change = sum(v * v for v in after.values()) - total
                if best is None or change < best[0]:
                    best = change, g
            g = best[1]
            s = len(gaps) if g == capacity else [s for s, o in gaps.items() if o == g][0]
            at[k] = g
            gaps[s] = g - sizes[k]
        return gaps, at

    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    return place(order, True)


def test_pack_as_a_whole():
    rng = random.Random(8)
    for n in (1, 7, 60, 150):
        sizes = [rng.choice([rng.randint(1, 40), rng.randint(1, 9)]) for _ in range(n)]
        gaps, at = plain_packing(sizes, 40)
        first = packing.SumOfSquares(40)
        for k in sorted(range(n), key=lambda k: -sizes[k]):
            assert 40 - first.place(sizes[k])[1] == at[k]
        assert Counter(g for g, held in first.open.items() for _ in held) == Counter(g for g in gaps.values() if g)
        placed = packing.pack(sizes, 40)
        by = defaultdict(list)
        for (s, o), size in zip(placed, sizes):
            by[s].append((o, size))
        for parts in by.values():
            assert [o for o, _ in sorted(parts)] == [sum(z for _, z in sorted(parts)[:j]) for j in range(len(parts))]
        assert -(-sum(sizes) // 40) <= len(by) <= len(gaps)


def test_packing_spreads_rows_without_identifier(spark):
    """Rows that are alike in everything don't gather in one share."""
    d = spark.createDataFrame([doc(None, "same text")] * 400, SCHEMA).repartition(4)
    rows = packing.pack_documents(d, P.path("word_bpe_49k.json"), 1, 64, partitions=8).collect()
    assert len(rows) == 400 and check_pieces(rows, d, 64, 1) < 30
    assert max(Counter(r.sequence_id >> 40 for r in rows).values()) < 120


def test_token_store(spark, docs, empty, tmp_path):
    path = P.path("byte_bpe_50k.json")
    rows = token_store.token_round_trip(docs, path, 0).collect()
    got = sorted(rows, key=lambda r: r.start)
    at, seen = 0, []
    for r in got:
        assert r.start == at
        at += r.n_tokens
        seen.append(-1 if r.doc_id is None else r.doc_id)
    assert seen == sorted(seen)
    want = Counter((r.doc_id, len(x := ids_of("byte_bpe_50k.json", r.text, 0)), zlib.crc32(np.array(x, "<u4").tobytes())) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert token_store.token_round_trip(empty, path, 0).count() == 0


def test_store_format():
    import zstandard

    out = io.BytesIO()
    w = token_store.StoreWriter(out, frame_ids=4)
    given = [(None, b""), (1, np.arange(3, dtype="<u4").tobytes()), (5, np.arange(11, dtype="<u4").tobytes()), (5, np.arange(2, dtype="<u4").tobytes())]
    for d, ids in given:
        w.add(d, ids)
    w.close()
    r = token_store.StoreReader(io.BytesIO(out.getvalue()), frame_ids=4)
    assert [(r.doc_id(k), b"".join(r.document(k))) for k in range(len(r))] == given and r.find(5) == [2, 3]
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert whole.startswith(b"".join(i for _, i in given))
    broken = bytearray(out.getvalue())
    broken[6] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        b"".join(b"".join(x.document(k)) for x in [token_store.StoreReader(io.BytesIO(bytes(broken)), frame_ids=4)] for k in range(4))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_word_is_encoded_once_with_all_its_marks(monkeypatch, name):
    """Symbols behind a word and a line's end before it don't take another call, and ids are the library's."""
    import public_tokenizers

    code = tokens.Encoder(public_tokenizers.path(name))
    whole, calls, words = tokens.Encoder.whole, [], []
    monkeypatch.setattr(tokens.Encoder, "whole", lambda self, text: calls.append(text) or whole(self, text))
    cut = code._words
    monkeypatch.setattr(code, "_words", lambda some: words.extend(some) or cut(some))
    text = " Beach###. Beach Beach&&& Beach***!\nBeach Beach%%%,\n Beach$$$"
    assert code.encode(text) == whole(code, text)
    assert not any("each" in c for c in calls) and len(set(words)) == len(words) <= 2
    rng = random.Random(3)
    pieces = ["a", "B", "\u00e9", "\u00df", "###", "$", "%", "&", "*", "|", ".", " ", "\n", "\n\n", " \n", "\t", "1", "'s", "<|endoftext|>", "_", "("]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert code.encode(text) == whole(code, text), text


def test_lm_scores(docs, empty):
    rows = lm_score.score_documents(docs).collect()
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for r in docs.collect() if not held(r.doc_id) for w in words(r.text))
    n, v = sum(c.values()), len(c)
    want = Counter((r.doc_id, held(r.doc_id), len(w := words(r.text)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for r in docs.collect())
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 for r in rows)
    assert lm_score.score_documents(empty).count() == 0


def plain_lm_score(model, hot, counts, text):
    """log10 probability token by token, each step's probability from a plain sum over its alternatives."""
    units, (older, newer, first, second) = model.units, model.tables
    rank = {w: k for k, w in enumerate(hot["words"][: units.own])}
    a = b = units.start
    total = 0.0
    for w in (text or "").encode().lower().split() + [b"\n"]:
        c = zlib.crc32(w[-2:]) % lm_score.ENDINGS
        unit = rank.get(w, units.own + c)
        q = np.append(older[a].astype(float) + newer[b], 1.0)

        def chance(table, among, one):
            e = {x: math.exp(float(q @ table[x])) for x in among}
            return e[one] / sum(e.values())

        p = chance(first, range(len(first)), lm_score.ENDINGS + unit if unit < units.head else c)
        if unit >= units.head:
            p *= chance(second, units.members[c].tolist(), unit)
        if unit >= units.own:
            others = [n for x, n in counts.items() if x not in rank and zlib.crc32(x[-2:]) % lm_score.ENDINGS == c]
            p *= (counts[w] + 1) / (sum(others) + len(others) + 1)
        total += math.log10(p)
        a, b = b, unit
    return total


def test_lm_scores_against_a_plain_version(spark, docs, monkeypatch):
    """Scores with words that have embeddings, that share their class and that no training document has."""
    monkeypatch.setattr(lm_score, "HEAD", 20)
    monkeypatch.setattr(lm_score, "HOT", 150)
    monkeypatch.setattr(lm_score, "own_words", lambda distinct: 60)
    few = docs.filter("doc_id IS NULL OR doc_id NOT IN (300)")
    rows = lm_score.score_documents(few).collect()
    read = few.withColumn("held", lm_score.crc_remainder(F.col("doc_id"), 7) == 2).withColumnRenamed("text", lm_score.OWN + "text")
    train = read.filter("NOT held")
    counted = lm_score.word_counts(train).cache()
    model, hot, total, distinct = lm_score.fit(spark, train, counted)
    assert 0 < model.units.own < len(hot["words"]) < distinct
    counts = Counter({bytes(r.word): r.n for r in counted.collect()})
    want = Counter((r.doc_id, len((r.text or "").split()) if (r.text or "").isascii() else None, round(plain_lm_score(model, hot, counts, r.text), 2)) for r in few.collect() if (r.text or "").isascii())
    texts = Counter((r.doc_id, r.n_tokens - 1, round(r.score, 2)) for r in rows)
    close = lambda x, y: abs(x - y) < 0.02 + 1e-4 * abs(y)
    for doc_id, n, score in want:
        assert any(d == doc_id and m == n and close(score, s) for d, m, s in texts), (doc_id, n, score)


def test_lm_is_normalised_and_learns():
    """Both steps' probabilities sum to one, and an order of units is learned."""
    words = [b"w%d" % k + e for k in range(400) for e in (b"aa", b"bb")]
    units = lm_score.Units(words, np.linspace(900, 1, len(words)), np.full(lm_score.ENDINGS, 5000.0) + 400_000 * np.isin(np.arange(lm_score.ENDINGS), [lm_score.ending_class(b"aa"), lm_score.ending_class(b"bb")]))
    m = lm_score.LogBilinear(units)
    rng = np.random.default_rng(0)
    older, newer = rng.integers(0, 200, 60_000), rng.integers(0, 200, 60_000)
    unit = 3 * newer + 1
    for _ in range(12):
        m.train(older, newer, unit)
    every = np.arange(units.start)
    p = np.exp(m.log_probability(np.full(units.start, 3), np.full(units.start, 150), every))
    assert p.sum() == pytest.approx(1, abs=1e-4) and p.argmax() == 451


@pytest.mark.parametrize("scale", [1, 80])
def test_lm_sums_of_a_context_are_taken_once(monkeypatch, scale):
    """Contexts that occur again cost nothing more, and scores beyond the range of float32 lose nothing."""
    words = [b"w%d" % k for k in range(900)]
    m = lm_score.LogBilinear(lm_score.Units(words, np.linspace(900, 1, len(words)), np.full(lm_score.ENDINGS, 5000.0)))
    for table in m.tables:
        table *= scale**0.5
    rng = np.random.default_rng(0)
    older, newer, unit = np.tile([3, 4, 5], 900), np.tile([7, 8, 9], 900), rng.integers(0, m.units.start, 2700)
    rows, sums = [], lm_score.LogBilinear._log_sums
    monkeypatch.setattr(lm_score.LogBilinear, "_log_sums", staticmethod(lambda q, outputs: rows.append(len(q)) or sums(q, outputs)))
    got = m.log_probability(older, newer, unit)
    assert max(rows) == 3 and sum(rows) <= 3 * (1 + lm_score.ENDINGS)
    for a, b, t, p in list(zip(older, newer, unit, got))[:300]:
        q = np.append(m.tables[0][a].astype(float) + m.tables[1][b], 1.0)

        def log_share(outputs, place):
            x = outputs.astype(float) @ q
            return x[place] - x.max() - np.log(np.exp(x - x.max()).sum())

        want = log_share(m.tables[2], m.units.first[t])
        if t >= m.units.head:
            want += log_share(m.tables[3][m.units.members[m.units.first[t]]], m.units.place[t])
        assert p == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_lm_tokens_of_a_context_meet_the_noise_together(monkeypatch):
    """Each group of a context's tokens is one row; the order of tokens is of no account; gradients are those token by token."""
    words = [b"w%d" % k for k in range(900)]
    new = lambda: lm_score.LogBilinear(lm_score.Units(words, np.linspace(900, 1, len(words)), np.full(lm_score.ENDINGS, 5000.0)))
    m, other, rng = new(), new(), np.random.default_rng(0)
    older, newer, unit = np.tile([3, 4, 5], 900), np.tile([7, 8, 9], 900), rng.integers(0, m.units.start, 2700)
    rows, learn = [], m._contrast
    monkeypatch.setattr(m, "_contrast", lambda q, *rest: rows.append(len(q)) or learn(q, *rest))
    m.train(older, newer, unit)
    assert sum(rows) == 2700 / lm_score.SAME
    k = rng.permutation(2700)
    other.train(older[k], newer[k], unit[k])
    assert (other.state() == m.state()).all()

    few, drawn, steps = rng.choice(2700, 60), [], []
    older, newer, unit, tables = older[few], newer[few], unit[few], [t.astype(float) for t in m.tables]
    monkeypatch.setattr(m, "_contrast", lambda q, *rest: drawn.append(rest[-1]) or learn(q, *rest))
    monkeypatch.setattr(m, "_step", lambda k, at, grad: steps.append((k, *m._added_up(at, grad))))
    m.train(older, newer, unit)
    (noise,), want = drawn, [np.zeros(t.shape) for t in m.stacked]
    outputs = np.concatenate(tables[2:])
    for a, b, t in zip(older, newer, unit):
        q = np.append(tables[0][a] + tables[1][b], 1.0)
        chosen = [(m.units.first[t], noise[: lm_score.NOISE])] + [(t + m.second, noise[lm_score.NOISE :])] * int(t >= m.units.head)
        for target, false in chosen:
            for o, is_target in [(target, 1), *((x, 0) for x in false)]:
                g = 1 / (1 + np.exp(m.log_drawn[o] - q @ outputs[o])) - is_target
                want[1][o] += g * q
                want[0][[a, b + m.units.start + 1]] += g * outputs[o][:-1]
    for k, at, grad in steps:
        got = np.zeros(want[k].shape)
        got[at] = grad
        assert np.allclose(got, want[k], atol=1e-3, rtol=1e-3), k


def test_lm_classes_of_words():
    words = [b"a", b"ab", b"\xc3\xa9", b"xyz", lm_score.END]
    assert lm_score.ending_classes(pa.array(words, pa.binary())).tolist() == [lm_score.ending_class(w) for w in words]


def test_lm_words_of_texts():
    texts = [None, "", " ", "A b\tA\x1c\xa0\u00c0 ", "\n x\r\x0bX\x0c\u0130 end"]
    for some in ([None], texts, texts[3:]):
        coded = lm_score.Coded(pa.array(some, pa.string()))
        words = coded.distinct()
        assert [[words[k] for k in x] for x in np.split(coded.numbers, coded.begins[1:])] == [(t or "").encode().lower().split() + [b"\n"] for t in some]
    batch = pa.RecordBatch.from_pydict({"t": ["x" * (lm_score.TOGETHER // 2)] * 5 + [None]})
    assert [len(x) for x in lm_score.parts_of(batch, "t")] == [2, 2, 2]


def test_lm_contexts():
    older, newer, unit = lm_score.contexts([np.array([5, 6, 7], np.int32), np.array([8], np.int32)], 99)
    assert older.tolist() == [99, 99, 5, 99] and newer.tolist() == [99, 5, 6, 99] and unit.tolist() == [5, 6, 7, 8]
    assert [len(x) for x in lm_score.contexts([], 9)] == [0, 0, 0]


def test_lm_learns_from_all_documents(spark):
    """An order that is in no document of a hash sample of 1,000,000 tokens is learned from the others."""
    rng = random.Random(5)
    number = lambda k: int(hashlib.md5(f"lm{k}".encode()).hexdigest()[:13], 16) / 2**52
    rows, total, each = [], 1_500_000, 3000
    for k in range(total // each):
        cyclic = number(k) >= 0.8 or zlib.crc32(str(k).encode()) % 7 == 2
        rows.append((k, " ".join(f"w{(j if cyclic else rng.randrange(10)) % 10}" for j in range(each))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held = [r for r in lm_score.score_documents(df).collect() if r.held_out]
    assert held and all(r.score / r.n_tokens > -0.85 for r in held)
    assert lm_score.own_words(10**8) > 2 * lm_score.own_words(10**7) > 4 * lm_score.own_words(10) == 4 * lm_score.OWN_WORDS


def test_lm_predicts_held_out_documents(spark):
    """Better by far than counts alone on text that no training document has."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm_score.score_documents(d).filter("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("model"), (F.sum("base_score") / F.sum("n_tokens")).alias("base")).first()
    assert r.model > -3.78 and r.model > r.base + 0.25


def test_shards(spark, docs, empty):
    out = sharding.shard_documents(docs, 2000)
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns == [*docs.columns, "shard", "shard_depth", "shard_bytes", "shard_docs"]
    size, n = Counter(), Counter()
    for r in rows:
        bits = format(int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:13], 16), "052b")
        assert bits.startswith(r.shard) and len(r.shard) == r.shard_depth
        size[r.shard] += len((r.text or "").encode())
        n[r.shard] += 1
    for s in size:
        assert not any(o != s and o.startswith(s) for o in size)
        assert size[s] <= 2000 or n[s] == 1
    assert all((r.shard_bytes, r.shard_docs) == (size[r.shard], n[r.shard]) for r in rows)
    assert sharding.shard_documents(empty, 10).count() == 0
    assert {r.shard for r in sharding.shard_documents(docs, 10**9).collect()} == {""}


def test_directory_stays_on_executors(spark, tmp_path):
    """A directory of many shards comes as tables, without a row of it in the driver; shards are folders."""
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, F.repeat(F.lit("y"), 5000)).otherwise(F.lit("x" * 39)).alias("text"))
    levels = sharding.directory(d.select(sharding.hash_bits(F.col("doc_id")).alias("bits"), F.length("text").cast("long").alias("n_bytes")), 40)
    assert len(levels) > 1 and all(hasattr(found, "sparkSession") for _, found in levels)
    out = sharding.shard_documents(d, 40)
    rows = out.collect()
    assert len({r.shard for r in rows}) > 700 and all(r.shard_bytes <= 40 or r.shard_docs == 1 for r in rows)
    few = out.filter("doc_id < 200")
    sharding.write_shards(few, str(tmp_path / "shards"))
    back = spark.read.option("mergeSchema", "false").schema("doc_id long, text string, shard string").parquet(str(tmp_path / "shards"))
    want = {r.doc_id: r.shard for r in rows if r.doc_id < 200}
    assert {r.doc_id: r.shard for r in back.collect()} == want
    assert len(list((tmp_path / "shards").glob("shard=*"))) == len(set(want.values()))


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def plain_components(rows, width, percent=80):
    by = defaultdict(set)
    for r in rows:
        if r.doc_id is not None:
            by[r.doc_id].add(shingles(r.text, width))
    label = {i: i for i in by}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(by)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in by[a] for y in by[b]):
                p, q = root(a), root(b)
                label[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, empty, width):
    want = plain_components(docs.collect(), width)
    rows = near_dup.near_duplicates(docs, width=width).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.component_id == r.doc_id)
    assert Counter((r.doc_id, r.n_shingles) for r in rows) == Counter((r.doc_id, len(shingles(r.text, width))) for r in docs.collect())
    assert near_dup.near_duplicates(empty).count() == 0
    assert {r.kept for r in near_dup.near_duplicates(docs.filter("doc_id = 203")).collect()} == {True}


def test_near_duplicates_of_repeated_identifiers(spark):
    """An identifier with several texts joins the components of all of them."""
    line = lambda x: " ".join(f"{x}{k}" for k in range(30))
    a, b, c, d = map(line, "abcd")
    given = [(3, a), (7, a), (7, b), (12, b), (12, ""), (12, None), (20, c), (5, c + " end"), (5, d), (5, d), (30, d), (40, ""), (40, ""), (41, line("e")), (41, line("e")), (None, a), (8, line("f")), (8, line("g"))]
    df = spark.createDataFrame([doc(*r) for r in given], SCHEMA).repartition(3)
    rows = near_dup.near_duplicates(df, width=2).collect()
    want = plain_components(df.collect(), 2)
    assert want[12] == 3 and want[20] == want[30] == 5
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in given)
    assert all(r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id == r.component_id) for r in rows)


def test_blocks_of_buckets(spark):
    """Buckets that are cut into blocks, by members or by shingles, give the same components."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    rows = [doc(k, " ".join(base[: 30 + k % 9] + [f"x{rng.randrange(4)}" for _ in range(3)] + base[40:])) for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain_components(df.collect(), 2)
    for block, shingles_ in ((4, 10**9), (10**9, 300)):
        kept = near_dup.BLOCK, near_dup.BLOCK_SHINGLES
        near_dup.BLOCK, near_dup.BLOCK_SHINGLES = block, shingles_
        try:
            assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, width=2).collect()} == want
        finally:
            near_dup.BLOCK, near_dup.BLOCK_SHINGLES = kept


def test_remaining_links_find_chains(spark):
    """A chain whose ends are unlike: every link is found though the bucket's pivot is far."""
    words = [f"w{k}" for k in range(120)]
    chain = [doc(k, " ".join(words[3 * k :] + [f"x{j}" for j in range(3 * k)])) for k in range(12)]
    d = spark.createDataFrame(chain, SCHEMA)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(d, width=2).collect()}
    assert got == plain_components(d.collect(), 2)


def test_components(spark):
    rng = random.Random(2)
    edges = [(a, b) for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(230)) if a != b]
    near_dup_most, near_dup.MOST_NODES = near_dup.MOST_NODES, 20
    scratch = near_dup.Scratch(spark)
    try:
        e = spark.createDataFrame(edges, "a long, b long").repartition(5)
        got = {r.node: r.label for r in near_dup.components(e, scratch).collect()}
    finally:
        near_dup.MOST_NODES = near_dup_most
        scratch.drop()
    label = {x: x for p in edges for x in p}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            m = min(label[a], label[b])
            moved |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    assert got == label


def test_host_quality(docs, empty):
    rows = host_quality.host_quality(docs, min_words=10).collect()
    want = Counter()
    for r in docs.collect():
        t = r.text or ""
        w = t.encode().split()
        tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want[r.doc_id, len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    assert all(not r.kept for r in rows if r.base_failed) and any(r.kept for r in rows)
    assert host_quality.host_quality(empty).count() == 0


def test_repeated_words(spark):
    texts = ["a b c a b c", "a b c d a b c", "a a a a", "a b", "", "x y z " * 5 + "q", "p q r s t u v"]
    d = spark.createDataFrame([doc(k, t) for k, t in enumerate(texts)], SCHEMA)
    assert [r.n_repeat_words for r in host_quality.host_quality(d).orderBy("doc_id").collect()] == [6, 6, 4, 0, 0, 15, 0]


def test_bad_hosts_go(spark):
    good = [doc(k, " ".join(f"w{k}x{j}" for j in range(80)), source="good") for k in range(30)]
    bad = [doc(100 + k, "spam spam spam " * 40, source="bad") for k in range(30)] + [doc(199, " ".join(f"v{j}" for j in range(80)), source="bad")]
    rows = {r.doc_id: r for r in host_quality.host_quality(spark.createDataFrame(good + bad, SCHEMA)).collect()}
    assert all(rows[k].kept for k in range(30)) and not rows[199].base_failed and not rows[199].kept


def test_url_rules(spark):
    urls = ["http://a.org/x", "https://WWW.example.org/es/1?q", "http://example.org/en/12#f", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/1", "http://x.com/", "http://org", "http://borg/x", None, "no scheme", "a://example.org.evil.net/es/", "http://x\x01y.org/a", "http://.com/fr/"]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)] + [(0, urls[0], "h", "r")], "page_id long, url string, html string, rule string")
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    rows = url_rules.judge_urls(pages, table).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.lower()
        fit = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, max(fit)[3] if fit else None, max(fit)[2] if fit else "allow")
    assert url_rules.judge_urls(pages, table.limit(0)).filter("verdict = 'allow' AND rule IS NULL").count() == len(rows)
    assert url_rules.judge_urls(pages.limit(0), table).count() == 0


def best_rule(host, path, rules):
    fit = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fit)[3], max(fit)[2]) if fit else (None, "allow")


def test_many_nested_url_rules(spark):
    """Nested paths, nested hosts, one hot host and repeated urls, over many ranges."""
    rng = random.Random(12)
    hosts = ["a", "b.a", "c.b.a", "x.a", "ab", "z", "a.z", "B.a"]
    paths = ["", "/", "/p", "/p/q", "/p/q/r", "/pq", "/x", "/é", "/p/q/\U0010ffff", "/x/y"]
    rules = [(h.lower(), p, rng.choice(["allow", "block"])) for h in hosts for p in paths if rng.random() < 0.5]
    rules += [("a", "/p", "block"), ("a", "/p", "allow"), (None, "/p", "block"), ("a", None, "block")]
    urls = [f"http://{rng.choice(['', 'w.', 'w.v.'])}{'a' if rng.random() < 0.6 else rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '/', 'q', '?p', '#f'])}" for _ in range(900)]
    urls += ["http://c.b.a/p/q"] * 300
    pages = spark.createDataFrame(list(enumerate(urls)) + [(5, urls[5])], "page_id long, url string").repartition(5)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    rows = url_rules.judge_urls(pages, table).collect()
    assert Counter(r.page_id for r in rows) == Counter([*range(len(urls)), 5])
    known = [r for r in rules if None not in r]
    for r in rows:
        assert (r.rule, r.verdict) == best_rule(r.host, r.path, known), (urls[r.page_id], r)


def test_boundaries_are_not_copied(spark):
    """A sweep reads each boundary once, whatever the number of ranges."""
    rules = spark.range(3000).selectExpr("concat('h', id, '.org') AS host", "'/a' AS path", "'block' AS verdict")
    assert url_rules.host_boundaries(rules).count() == url_rules.path_boundaries(rules).count() == 6000
    marks = url_rules.host_boundaries(rules)
    d = spark.createDataFrame([("h7.org",)], "host string").select(url_rules.key_of(url_rules.host_labels(F.col("host"))).cast("binary").alias("key"), F.lit(1).cast("long").alias(url_rules.TIE))
    assert url_rules.sweep(d, marks, "stack").first()["stack"] == ["h7.org"]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(spark, docs, empty, keep):
    many = docs.union(spark.createDataFrame([doc(1000 + k, "hot text") for k in range(200)], SCHEMA))  # a hot group
    out = content_dedup.exact_dedup(many, keep=keep)
    rows = out.collect()
    assert len(rows) == many.count()
    groups = defaultdict(list)
    for r in many.collect():
        groups[r.text or ""].append(r.doc_id)
    for r in rows:
        g = groups[r.text or ""]
        known = [i for i in g if i is not None]
        pick = (max if keep == "largest" else min)(known) if known else None
        assert (r.keep_id, r.group_size) == (pick, len(g)) and r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    for text, g in groups.items():
        assert sum(r.kept for r in rows if (r.text or "") == text) == 1, text[:20]
    assert content_dedup.exact_dedup(empty).count() == 0
    lower = content_dedup.exact_dedup(docs.filter("doc_id IN (203, 204)"), normalise=F.lower).filter("kept").count()
    assert lower == 1


@pytest.mark.parametrize("hot", [False, True])
def test_exact_dedup_sorts_whole_texts_once(spark, hot):
    """Texts go through one exchange, which is by range of their content, and the window uses its order."""
    long_ = "the same opening of many texts " * 9
    rows = [doc(k, long_ + f"{k % 40}") for k in range(120)] + [doc(None, long_ + "0"), doc(None, "no id"), doc(None, "no id")]
    rows += [doc(None if k % 3 else 500 + k, "hot text") for k in range(150)] + [doc(None, "hot, none known")] * 90 if hot else []
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = content_dedup.exact_dedup(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    with_texts = [x for x in plan.split("Final Plan")[-1].splitlines() if "Exchange rangepartitioning" in x]
    assert len(with_texts) == 1 and "Exchange hashpartitioning" not in (plan if not hot else "")
    groups = defaultdict(list)
    for r in df.collect():
        groups[r.text].append(r.doc_id)
    got = defaultdict(list)
    for r in out.collect():
        got[r.text].append(r)
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        assert {(r.keep_id, r.group_size) for r in got[t]} == {(max(known) if known else None, len(ids))}
        assert [r.doc_id for r in got[t] if r.kept] == [max(known) if known else None] and len(got[t]) == len(ids)


def test_toxicity(spark, docs, empty, labels):
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    assert all(r.held_out == held(r.doc_id) for r in rows)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert toxicity.score_toxicity(docs, labels.limit(0)).count() == docs.count()
    kept = toxicity.score_toxicity(docs, labels, keep_columns=True)
    assert kept.columns == [*docs.columns, "toxic_score", "toxic_predicted"] and kept.count() == docs.count()


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    words = ["ban", "cor", "del", "fin", "gor", "hul", "kes", "lam"]
    text = lambda: [rng.choice(words) + rng.choice(words) for _ in range(60)]
    rows, marks = [], []
    for k in range(600):
        t, bad = text(), k % 4 == 0
        if bad:
            for _ in range(4):
                t.insert(rng.randrange(60), rng.choice(["idiot", "zarg" + rng.choice(words)]))
        rows.append(doc(k, " ".join(t)))
        marks.append((k, 1, int(bad)))
    got = toxicity.score_toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).filter("held_out").collect()
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in got]) > 0.97


def plain_clauses(text, stems):
    """Counts by arc of each clause, word by word and without machines."""
    out = []
    for clause in re.split(r"[.,;:!?\n|]+", text.lower()):
        path, negated, reported, directed = Counter(), 0, False, 0
        for w in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause):
            stem = next((s for s in sorted(stems, key=len) if w.startswith(s)), None)
            kind = "R" if w in toxicity.REPORTS else "N" if w in toxicity.NEGATIONS else "Y" if w in toxicity.TARGETS else "threat" if w in toxicity.THREATS else "insult" if w in toxicity.INSULTS else stem or "o"
            if kind == "N":
                negated, kind = 3, "o"
            elif negated:
                negated -= 1
                if kind not in "RYo":
                    path[kind] += 1
                    path["negated"] += 1
                    continue
            if kind == "R":
                reported, kind = True, "o"
            elif reported and kind not in "Yo":
                path[kind] += 1
                path["reported"] += 1
                continue
            if kind == "Y":
                directed = 4
            elif kind == "o":
                directed = max(0, directed - 1)
            else:
                path[kind] += 1
                if directed:
                    path["directed"] += 1
                    directed = 4
        if path:
            out.append(path)
    return out


def test_grammar():
    g = toxicity.Grammar(["zarg"])
    at = lambda text: [{w: n for w, n in zip(g.names, c) if n} for c in g.clauses(text)]
    assert at("what an idiot.") == [{"insult": 1}]
    assert at("you are an idiot") == [{"insult": 1, "directed": 1}]
    assert at("he is not an idiot, fine") == [{"insult": 1, "negated": 1}]
    assert at("the paper said idiot twice") == [{"insult": 1, "reported": 1}]
    assert at("the paper said so. Idiot") == [{"insult": 1}]
    assert at("zargons all over! you, kill it") == [{"zarg": 1}, {"threat": 1}] and at("") == []
    rng = random.Random(2)
    words = ["idiot", "zargo", "kill", "you", "not", "said", "word", "Moron", "x", "don't", ".", ",", "\n", "zar"]
    for _ in range(1500):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
        assert at(text) == [dict(c) for c in plain_clauses(text, ["zarg"])], text


def taught_scene(spark, words, n=200):
    """Documents with labels, a quarter toxic by a word that no list has."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("bdfgklmnprstaeiou") for _ in range(rng.randint(3, 9))) for _ in range(5000)]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(vocabulary) for _ in range(words))
        rows.append((k, text + (f" you zorglak{rng.choice('aeiou')}. and more" if k % 4 == 0 else "."), int(k % 4 == 0)))
    return spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string"), spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, toxic int")


def test_toxicity_learns_beside_labels_of_other_documents(spark):
    few, own = taught_scene(spark, 30)
    alone = toxicity.fit(few, own)
    others = spark.range(1000, 201000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert alone["stems"] and toxicity.fit(few, own.union(others)) == alone
    # rows and labels that repeat teach nothing more
    assert toxicity.fit(few.union(few), own.union(own)) == alone


def test_toxicity_learns_from_long_texts(spark):
    few, own = taught_scene(spark, 4000)
    assert few.selectExpr("min(length(text))").first()[0] > toxicity.FIT_BYTES
    model = toxicity.fit(few, own)
    assert model["stems"] and model["weights"] != list(toxicity.UNTAUGHT)
    got = toxicity.score_toxicity(few, own).join(own, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in got) > 0.95 * len(got)


def test_rows_to_learn_from_are_bounded(spark, monkeypatch):
    few, own = taught_scene(spark, 30, 80)
    text = few.select(F.col("doc_id").alias("__fl_id"), "text").withColumn("hash", F.xxhash64("text"))
    y = own.select(F.col("doc_id").alias("__fl_id"), F.col("toxic").alias("y"))
    monkeypatch.setattr(toxicity, "FIT_TOTAL", 1000)
    sizes = {r[0]: len(r[1]) for r in few.collect()}
    chosen = toxicity.chosen_rows(text, y)
    for label in (0, 1):
        assert 1 < sum(c[2] == label for c in chosen) and sum(sizes[c[0]] for c in chosen if c[2] == label) <= 1000
    # longer texts only where the others are few
    monkeypatch.setattr(toxicity, "FIT_TOTAL", 10**9)
    longer = text.withColumn("text", F.when(F.col("__fl_id") % 8 == 0, F.expr("repeat('a b ', 20000)")).otherwise(F.col("text"))).withColumn("hash", F.xxhash64("text"))
    assert sum(c[2] for c in toxicity.chosen_rows(longer, y)) == 20
    monkeypatch.setattr(toxicity, "FIT_LEAST", 5)
    assert sum(c[2] for c in toxicity.chosen_rows(longer, y)) == 10
    monkeypatch.setattr(toxicity, "FIT_TOTAL", 1)
    assert sorted(c[2] for c in toxicity.chosen_rows(text, y)) == [0, 1]


def test_clauses_of_a_long_text_take_linear_time():
    import time

    g = toxicity.Grammar([])
    text = ("word " * 8 + "you idiot. ") * 100_000
    began = time.process_time()
    assert len(g.clauses(text)) == 100_000
    assert time.process_time() - began < 40
    assert g.clauses("a b " * 1_000_000 + "you idiot") == g.clauses("a b a b a b a b a b you idiot")


def test_toxicity_scores_against_a_plain_version(spark):
    """Scores from the fitted arcs' weights, clause by clause; clashing labels and identifiers that repeat."""
    rng = random.Random(7)
    words = ["idiot", "you", "not", "said", "kill", *(f"{a}{b}" for a in ("ban", "cor", "del") for b in ("fin", "gor", "hul")), ".", ","]
    texts = {k: " ".join(rng.choice(words) for _ in range(30)) for k in range(150)}
    d = spark.createDataFrame([doc(k, t) for k, t in texts.items()] + [doc(3, "an idiot"), doc(None, "you idiot"), doc(900, None)], SCHEMA)
    marks = [(k, 1, int("idiot" in t)) for k, t in texts.items()] + [(1, 1, 0), (1, 1, 1), (2, 1, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, labels)
    assert model == toxicity.fit(d, labels.orderBy(F.desc("toxic")).repartition(3)), "row order must not matter"
    names = [*toxicity.WEIGHTS, *model["stems"]]
    weight, clause_0, doc_0 = dict(zip(names, model["weights"])), model["weights"][-2], model["weights"][-1]
    logistic = lambda x: 1 / (1 + math.exp(-x))
    for r in toxicity.score_toxicity(d.withColumnRenamed("kept", "score"), labels).join(d.select("doc_id", "text"), "doc_id").collect():
        if r.doc_id == 3:
            continue
        clean = 1 - logistic(doc_0)
        for c in plain_clauses(r.text or "", model["stems"]):
            clean *= 1 - logistic(sum(weight[w] * n for w, n in c.items()) + clause_0)
        assert r.score == pytest.approx(1 - clean, abs=1e-9) and r.predicted == (r.score >= 0.5)
    untaught = toxicity.fit(d, labels.filter("toxic = 0"))
    assert untaught == {"stems": [], "weights": list(toxicity.UNTAUGHT)}


def test_weights_minimise_the_loss():
    rng = np.random.default_rng(3)
    paths, row = rng.integers(0, 3, (200, 5)).astype(float), np.sort(rng.integers(0, 120, 200))
    y = (rng.random(120) < 0.4).astype(float)

    def loss(w):
        p = toxicity.document_scores(paths, row, 120, w)
        return -(y * np.log(p) + (1 - y) * np.log1p(-p)).sum() + 0.025 * (w * w).sum()

    w = toxicity.fit_weights(paths, row, y)
    for k in range(len(w)):
        for step in (-0.02, 0.02):
            other = w.copy()
            other[k] += step
            assert loss(other) >= loss(w) - 1e-4


def test_mixing(docs, empty):
    out = mixing.mix_sources(docs, share=0.6)
    rows = out.collect()
    assert len(rows) == docs.count() and set(docs.columns) <= set(out.columns)
    tokens_, cell = Counter(), {}
    for r in rows:
        assert r.n_tokens == len((r.text or "").encode().split())
        tokens_[r.source, r.lang, r.topic] += r.n_tokens
        cell[r.source, r.lang, r.topic] = r
        u = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:13], 16) / 2**52
        assert r.selected == (u < r.probability)
    total = sum(tokens_.values())
    assert sum(tokens_[k] * cell[k].probability for k in cell) == pytest.approx(0.6 * total, rel=1e-6)
    margin = Counter()
    for k, n in tokens_.items():
        margin[k[0]] += n / total
    want = {k: v**0.7 for k, v in margin.items()}
    got = Counter()
    for k, r in cell.items():
        got[k[0]] += r.weight
    for k in want:
        assert got[k] == pytest.approx(want[k] / sum(want.values()), abs=1e-6)
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_sample_meets_targets(docs):
    """Expected and drawn copies, not only the weights, have the target margins."""
    rows = mixing.mix_sources(docs, share=0.8).collect()
    total = sum(r.n_tokens for r in rows)
    for d in ("source", "lang", "topic"):
        have, got = Counter(), Counter()
        for r in rows:
            have[r[d]] += r.n_tokens / total
            got[r[d]] += r.n_tokens * r.probability / (0.8 * total)
        want = {k: v**0.7 for k, v in have.items()}
        for k in want:
            assert got[k] == pytest.approx(want[k] / sum(want.values()), abs=1e-6)
    assert all(r.selected == (r.copies > 0) and abs(r.copies - r.probability) < 1 for r in rows)
    assert max(r.copies for r in rows) > 1


def test_mixing_without_repeats_meets_targets(docs):
    """No document twice, and still the target margins, at the greatest share that allows it."""
    for exponent in (0.7, 0.9):
        rows = mixing.mix_sources(docs, share=0.9, exponent=exponent, repeat=False).collect()
        assert max(r.copies for r in rows) == 1 and all(0 <= r.probability <= 1 + 1e-9 for r in rows)
        total, kept, least = sum(r.n_tokens for r in rows), sum(r.n_tokens * r.probability for r in rows), 0.9
        for d in ("source", "lang", "topic"):
            have, got = Counter(), Counter()
            for r in rows:
                have[r[d]] += r.n_tokens / total
                got[r[d]] += r.n_tokens * r.probability / kept
            want = {k: v**exponent for k, v in have.items() if v}
            goal = {k: v / sum(want.values()) for k, v in want.items()}
            least = min(least, *(have[k] / goal[k] for k in goal))
            for k in goal:
                assert got[k] == pytest.approx(goal[k], abs=1e-6), (d, k)
        assert kept / total == pytest.approx(least, rel=1e-6)


def plain_raking(rows, exponent, share, rounds=500):
    """Weights and rates by cell, from dictionaries only."""
    tokens = Counter()
    for r in rows:
        tokens[r.source, r.lang, r.topic] += len((r.text or "").encode().split())
    total = sum(tokens.values())
    goals = []
    for k in range(3):
        have = Counter()
        for c, n in tokens.items():
            have[c[k]] += n / total
        goals.append({x: v**exponent / sum(u**exponent for u in have.values() if u) for x, v in have.items() if v})
    w = {c: n / total for c, n in tokens.items()}
    for _ in range(rounds):
        worst = 0
        for k, goal in enumerate(goals):
            margin = Counter()
            for c, v in w.items():
                margin[c[k]] += v
            worst = max(worst, *(abs(margin[x] - goal.get(x, 0)) for x in margin))
            w = {c: v * goal.get(c[k], 0) / margin[c[k]] if margin[c[k]] else 0 for c, v in w.items()}
        if worst < 1e-9:
            break
    return {c: (w[c], share * total * w[c] / n if n else 1.0) for c, n in tokens.items()}


@pytest.mark.parametrize("tables", [False, True])
def test_mixing_against_a_plain_version(spark, tables):
    """Both ways of raking, with nulls in every dimension, cells without tokens and repeated rows."""
    rng = random.Random(9)
    pick = lambda *x: rng.choice(x)
    given = [doc(k, None if k % 17 == 0 else " ".join(["w"] * rng.randint(0, 300)), pick("en", "de", None), pick("a", "b", "c", None)) for k in range(80)]
    given += given[:5] + [doc(None, "x y z", None, None), doc(300, "", "xx", "only empty")]
    df = spark.createDataFrame(given, SCHEMA)
    kept = mixing.MOST_CELLS
    mixing.MOST_CELLS = 0 if tables else kept
    try:
        rows = mixing.mix_sources(df, share=0.5).collect()
        once = mixing.mix_sources(df, share=0.5, repeat=False, targets={"source": {"a": 0.6, "b": 0.3, "gone": 0.1, None: 0.1}}).collect()
        none = mixing.mix_sources(df.filter("n_chars = 0"), share=0.5).collect()
    finally:
        mixing.MOST_CELLS = kept
    want = plain_raking(rows, 0.7, 0.5)
    for r in rows:
        w, p = want[r.source, r.lang, r.topic]
        assert r.weight == pytest.approx(w, abs=1e-7) and r.probability == pytest.approx(p, rel=1e-5, abs=1e-7)
    assert len(rows) == len(once) == len(given) and none and all(r.selected for r in none)
    spent = sum(r.n_tokens * r.probability for r in once)
    by = Counter()
    for r in once:
        by[r.source] += r.n_tokens * r.probability / spent
    assert [by[k] for k in ("a", "b", None, "c")] == pytest.approx([0.6, 0.3, 0.1, 0], abs=1e-6)
