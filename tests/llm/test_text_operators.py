"""Pieces, phrases and periodic runs on small tables with nulls, empty and long texts, ties, repeated rows, no
rows and clashing columns, against the library or plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import phrases, pieces, queries, runs

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, ids string, runs long, rank int, w1 string, row string, n long"


def doc(i, text, lang="en"):
    return (i, text, lang, "s", "x", 7, 1, "y", "z", 5)


def base_rows():
    rng = random.Random(11)
    words = [rng.choice("bcdfgl") + rng.choice("aeiou") * rng.randint(1, 2) + rng.choice(["", "n", "st"]) for _ in range(40)]
    line = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", "", ",", ".", "\n", "\t"]) for _ in range(n))
    rows = [doc(k, line(rng.randint(5, 120)).capitalize(), rng.choice(["en", "en", "de", None, "und"])) for k in range(1, 70)]
    rows += [doc(100 + k, "Of the Old, of the old house. The old house " * 5, "en") for k in range(4)]
    rows += [doc(200, ""), doc(201, None), doc(202, " \n\t "), doc(203, "one"), doc(204, ". , ;"), doc(205, None, None)]
    rows += [doc(None, "no id here " * 40), doc(None, None), doc(7, "an id again"), doc(203, "one")]
    rows += [doc(300, line(6000)), doc(301, "é ü ß　漢字 İ ▁x <unk></s> \x1c x\r\n \0 \U0001f600y"), doc(302, "ab " * 900 + "c " * 700), doc(303, "x" * 3000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(base_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_library(library):
    own = pieces.Pieces(MODEL)
    rng = random.Random(5)
    parts = [*"aAbZé ß01.,'’! \n\t\r\xa0　\x1c\x85İΣσ▁\0", "▁▁", "  ", "    ", "<s>", "</s>", "<unk>", "<0x0A>", "漢字", "한", "\U0001f600", "the", "ing", " of", "aaa", "ttt", "�"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz" * 3 + "  ABC.,;01") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += ["".join(rng.choice("aehinst") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    texts += ["a" * 5000, " " * 999, "ab" * 3000, "=-" * 500, ""]
    for x in texts:
        ids = np.frombuffer(own.encode(x), "<i4")
        want = library.encode(x)
        assert ids.tolist() == want, repr(x)
        assert own.decode(ids) == library.decode(want), repr(x)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), own.ids["▁"]]) for _ in range(rng.randint(0, 12))]
        assert own.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_pieces_cut_long_texts_and_fill_tables(library, monkeypatch):
    monkeypatch.setattr(pieces, "SEGMENT", 40)
    monkeypatch.setattr(pieces, "MOST_UNITS", 20)
    monkeypatch.setattr(pieces, "MOST_PAIRS", 5)
    own = pieces.Pieces(MODEL)
    for x in ("word, another  word.   " * 40 + "é" * 120, "x" * 300 + " y", " " * 200):
        assert np.frombuffer(own.encode(x), "<i4").tolist() == library.encode(x)


def test_pairs_that_fit_are_those_that_merging_gives():
    own = pieces.Pieces(MODEL)
    rng = random.Random(2)
    some = sorted(own.steps)
    for _ in range(4000):
        a, b = rng.choice(some), rng.choice(some)
        assert own.fit(a, b) == (own.merged(a + b)[0] == [a, b]), (a, b)
    for a, b in (("a", "漢"), ("\U0001f600", "the"), ("a", "a"), ("aa", "a"), ("a", "aa")):
        assert own.fit(a, b) == (own.merged(a + b)[0] == [a, b])


def test_pieces_rows(docs, empty, library):
    got = pieces.encode_pieces(docs, MODEL)
    rows = got.collect()
    want = Counter((r.doc_id, tuple(library.encode(r.text or "")), library.decode(library.encode(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in rows) == want
    back = pieces.decode_pieces(got.select("doc_id", "ids"), MODEL)
    assert Counter((r.doc_id, r.decoded) for r in back.collect()) == Counter((r.doc_id, r.decoded) for r in rows)
    assert pieces.encode_pieces(empty, MODEL).count() == 0
    assert pieces.encode_pieces(empty, MODEL).columns == ["doc_id", "ids", "decoded"]
    nulls = docs.sparkSession.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.decoded) for r in pieces.decode_pieces(nulls, MODEL).collect()) == [(1, None), (2, "")]


def test_op11_digests(spark, library):
    got = queries.op11_sentence_pieces(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# phrases


def plain_phrases(rows, least=10, top=2000, cover=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            lang_ = "und" if lang is None else lang
            n[lang_] += len(w)
            for k in (1, 2, 3):
                f[lang_].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in found.items():
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= cover * a for q, b in found.items())
            if not inside:
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_rows(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("top", [2000, 7])
def test_phrases(docs, top):
    want = plain_phrases([(r.text, r.lang) for r in docs.collect()], top=top)
    assert {r[0] for r in want} >= {"en", "und"} and len(want) > 7
    assert phrase_rows(phrases.mine_phrases(docs, top=top)) == want


def test_phrases_in_blocks_of_keys(docs):
    want = plain_phrases([(r.text, r.lang) for r in docs.collect()], least=4)
    assert phrase_rows(phrases.mine_phrases(docs, least=4, most_slots=300)) == want


def test_no_phrases(empty, spark):
    assert phrases.mine_phrases(empty).count() == 0
    assert phrases.mine_phrases(spark.createDataFrame([doc(1, None), doc(2, "a b c")], SCHEMA)).count() == 0


def test_chunks_of_long_texts_count_phrases_once(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(phrases, "CHUNK", 50)
    number = phrases.Numbering(0)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bb", "Ccc", "x" * 80]) + rng.choice([" ", " ", " ", "\t ", ".", "\n"]) for _ in range(rng.randint(1, 80)))
        got: Counter = Counter()
        for c in phrases._long_chunks("en", text.encode(), number, None):
            assert len(c.data) < 1000
            w = [c.data[a:b].lower().decode() for a, b in zip(c.starts, c.ends)]
            for k in (1, 2, 3):
                for i in range(max(0, c.skip - k + 1), len(w) - k + 1):
                    if all(c.joined[i : i + k - 1]):
                        got[tuple(w[i : i + k])] += 1
        want: Counter = Counter()
        for piece in re.split("[.\n]", text.lower()):
            w = piece.split()
            for k in (1, 2, 3):
                want.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        assert got == want


def test_words_that_share_numbers_are_told_apart(monkeypatch):
    import pyarrow as pa

    real = phrases.Numbering.__call__
    monkeypatch.setattr(phrases.Numbering, "__call__", lambda self, *a: real(self, *a) % np.uint64(2) + np.uint64(1) if self.seed == 0 else real(self, *a))
    batch = pa.RecordBatch.from_pydict({"__fl_lang": ["en"], "__fl_text": ["a b c d e f " * 3]})
    (c,) = phrases.chunks([batch], phrases.Numbering(0), phrases.Numbering(1000))
    assert len(set(c.w.tolist())) <= 2 and len(set(zip(c.w.tolist(), c.w2.tolist()))) == 6


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = [np.unique(rng.integers(1, 1 << 63, 5000, dtype=np.uint64)) for _ in range(1)]
    keys += [rng.integers(0, 9, len(keys[0]), dtype=np.uint64), np.zeros(len(keys[0]), np.uint64)]
    table = phrases.PerfectHash(keys)
    assert sorted(table.slots(*keys)) == list(range(len(keys[0])))
    assert (table.slots(keys[0], keys[1] + np.uint64(9)) == -1).all()
    assert (table.slots(rng.integers(1, 1 << 63, 5000, dtype=np.uint64)) == -1).all()
    with pytest.raises(ValueError):
        phrases.PerfectHash([np.zeros(2, np.uint64)] * 3)


def test_scores_are_exact():
    a, x = 3_000_000_019, 3_000_000_021
    assert phrases.cut_score(a, x, x, a, x) == (1000000 * a * a // (x * x), x, x)
    assert phrases.cut_score(10, 20, 20, 20, 20) == (250000, 20, 20)
    assert phrases.cut_score(10, 20, 20, 10, 30) == (250000, 20, 20)


# periodic runs


def plain_runs(w, least=24, exponent=3):
    n, out = len(w), []
    for p in range(1, n // exponent + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            s, e = i, j + p
            if e - s >= max(least, exponent * p) and not any(all(w[k] == w[k + q] for k in range(s, e - q)) for q in range(1, p)):
                out.append((s, e - s, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def patterned(rng):
    w = []
    for _ in range(rng.randint(0, 6)):
        if rng.random() < 0.5:
            base = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            w += (base * rng.randint(1, 9))[: rng.randint(1, 70)]
        else:
            w += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
    return w


def test_scan(monkeypatch):
    rng = random.Random(4)
    for _ in range(600):
        w = patterned(rng)
        least, exponent = rng.choice([(24, 3), (24, 3), (6, 2), (5, 4)])
        x, want = runs.numbers_of(w), plain_runs(w, least, exponent)
        assert runs.ordered(runs.scan(x, 1, len(w) + 1, least, exponent)) == want, w
        with monkeypatch.context() as m:
            m.setattr(runs, "SHORT_LAGS", 2)
            m.setattr(runs, "STEP", 16)
            merged: dict = {}
            ranges = runs.lag_ranges(len(w), least, exponent, rng.choice([5, 20, 100]))
            assert [a for _, a in ranges][:-1] == [a for a, _ in ranges][1:]
            for low, high in ranges:
                for k, p in runs.scan(x, low, high, least, exponent).items():
                    merged[k] = min(p, merged.get(k, p))
            assert runs.ordered(merged) == want


def plain_rows(docs):
    out = Counter()
    for r in docs.collect():
        w = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        found = plain_runs(w) if len(w) < 3000 else runs.ordered(runs.scan(runs.numbers_of(w), 1, len(w), 24, 3))
        top = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        out[r.doc_id, len(w), tuple(found), top, " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


def run_rows(df):
    t = lambda r: None if r is None else (r.start, r.length, r.period)
    return Counter((r.doc_id, r.n_words, tuple(map(t, r.runs)), t(r.top), r.collapsed) for r in df.collect())


def test_runs(docs, empty):
    rng = random.Random(8)
    extra = [doc(500 + k, " ".join(patterned(rng))) for k in range(60)]
    rows = docs.union(docs.sparkSession.createDataFrame(extra, SCHEMA)).cache()
    want = plain_rows(rows)
    assert sum(n for (_, _, found, _, _), n in want.items() if found) > 20
    assert run_rows(runs.periodic_runs(rows)) == want
    # every text dealt, in many ranges of lags
    assert run_rows(runs.periodic_runs(rows, long=0, work=200)) == want
    assert runs.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, exponent=1)


def test_top_run_is_exact():
    assert runs.top_run([]) is None
    assert runs.top_run([(0, 30, 10), (5, 24, 8), (9, 33, 11)]) == (0, 30, 10)
    assert runs.top_run([(0, 3 * 10**17 + 1, 10**17), (4, 3 * 10**17 + 2, 10**17)]) == (4, 3 * 10**17 + 2, 10**17)


def test_op13_digests(spark):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(rows)
    some = 0
    for r in rows:
        w = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = plain_runs(w) if n < 1500 else runs.ordered(runs.scan(runs.numbers_of(w), 1, n, 24, 3))
        top = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        o = got[r.doc_id]
        assert (o.n_runs, o.start, o.length, o.period) == (len(found), *top)
        assert o.exponent_milli == (1000 * top[1] // top[2] if found else None)
        assert o.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert o.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
        some += bool(found)
    assert some > 5


def test_with_repeats_has_no_row_lost(docs):
    out = queries.with_repeats(docs)
    assert out.count() == docs.count() and out.filter(F.col("text").isNull()).count() == 0
