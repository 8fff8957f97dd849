"""The pipeline's stages on small tables, each against a plain version of it on its own input."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm import test_operators as plain  # noqa: E402
from fathomline.llm import mixing, toxicity  # noqa: E402

CLASHES = ("toxic_score", "toxic_predicted", "keep_id", "group_size", "kept", "text_sha256", "topic", "n_tokens", "weight", "probability", "selected", "copies", "component_id", "node", "label")


def corpus():
    """Clean, toxic, copied, nearly copied, empty, null, very long and repeated rows."""
    rng = random.Random(11)
    words = [a + b for a in ("ban", "cor", "del", "fin", "gor", "hul") for b in ("a", "eo", "ith", "ust", "ra")]
    line = lambda n: [rng.choice(words) + str(rng.randrange(30)) for _ in range(n)]
    rows, marks = [], []
    for k in range(220):
        text = line(rng.randint(3, 70))
        if k % 5 == 0:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), "idiot")
        rows.append((k, " ".join(text), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None])))
        marks.append((k, 1, int(k % 5 == 0)))
    body = line(100)
    for k in range(12):
        changed = [*body[: 8 * k], f"new{k}", *body[8 * k + 1 :]] if k else body
        rows.append((300 + k, " ".join(changed), "en", "s1"))
    rows += [(320, " ".join(body), "de", "s0"), (321, "", "en", "s1"), (322, None, None, None), (323, "  ", "en", "s1"), (None, "no id", "en", "s0"), (None, None, "en", "s0"), (None, " ".join(body), "en", "s0")]
    rows += [(324, " ".join(line(9000)), "en", "s0"), rows[1], rows[1], (2, "another text of two", "en", "s0")]
    marks += [(1, 1, None), (999, 1, 1)]
    return rows, marks


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows, marks = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder), spark.read.parquet(f"{folder}/documents.parquet")


def plain_toxicity(rows, spark, sf):
    """Rows whose score, from the fitted weights and clause by clause, is below a half."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    weight = dict(zip([*toxicity.WEIGHTS, *model["stems"]], model["weights"]))
    logistic = lambda x: 1 / (1 + np.exp(-x))

    def clean(text):
        p = 1 - logistic(model["weights"][-1])
        for c in plain.plain_clauses(text or "", model["stems"]):
            p *= 1 - logistic(sum(weight[w] * n for w, n in c.items()) + model["weights"][-2])
        return p > 0.5

    return [r for r in rows if clean(r.text)]


def plain_exact(rows):
    best = {}
    for r in rows:
        t, i = r.text or "", -1 if r.doc_id is None else r.doc_id
        if t not in best or i > best[t][0]:
            best[t] = i, r
    return [r for _, r in best.values()]


def plain_near(rows):
    label = plain.plain_components(rows, 5)
    return [r for r in rows if r.doc_id is None or label[r.doc_id] == r.doc_id]


def plain_mixing(rows, topics):
    """Bounded raking over dictionaries to the shares to the power 0.9, then the draw by identifier."""
    words = lambda r: len((r.text or "").encode().split())
    cell = [(r.source, r.lang, t) for r, t in zip(rows, topics)]
    tokens = Counter()
    for c, r in zip(cell, rows):
        tokens[c] += words(r)
    total, budget, goals = sum(tokens.values()), 0.9, []
    for k in range(3):
        have = Counter()
        for c, n in tokens.items():
            have[c[k]] += n / total
        norm = sum(v**0.9 for v in have.values() if v)
        goals.append({x: v**0.9 / norm for x, v in have.items() if v})
        budget = min(budget, *(have[x] / g for x, g in goals[-1].items()))
    w = {c: n / total for c, n in tokens.items()}
    for _ in range(500):
        worst = 0
        for k, goal in enumerate(goals):
            margin = Counter()
            for c, v in w.items():
                margin[c[k]] += v
            worst = max(worst, *(abs(margin[x] - goal.get(x, 0)) for x in margin))
            w = {c: min(v * goal.get(c[k], 0) / margin[c[k]] if margin[c[k]] else 0, tokens[c] / total / budget) for c, v in w.items()}
        if worst < 1e-9:
            break
    import hashlib

    drawn = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:13], 16) / 2**52
    rate = {c: budget * total * w[c] / n if n else 1.0 for c, n in tokens.items()}
    return [r for r, c in zip(rows, cell) if drawn(r.doc_id) < rate[c]], rate


def test_stages_against_plain_versions(spark, tables):
    sf, docs = tables
    rows, before = docs.collect(), docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.schema == docs.schema, name
        if name == "toxicity":
            want = plain_toxicity(rows, spark, sf)
        elif name == "exact_dedup":
            want = plain_exact(rows)
        elif name == "near_dedup":
            want = plain_near(rows)
        else:
            marked = before.withColumn("kind", mixing.topic_of(F.col("text"))).collect()
            want, rate = plain_mixing(marked, [r.kind for r in marked])
        got = after.collect()
        key = lambda r: (r.doc_id is None, r.doc_id, r.text or "", r.source or "")
        assert sorted(map(key, got), key=str) == sorted(map(key, want), key=str), name
        # the user's columns come out as they went in, whatever they are called
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in got for c in CLASHES)
        assert 0 < len(got) < len(rows) or name == "mixing"
        rows, before = got, after
    pieces = pipeline.packing(spark, before, sf).collect()
    plain.check_pieces(pieces, before, 4096, 1)


def test_whole_run_equals_its_stages(spark, tables):
    sf, docs = tables
    by_hand = docs
    for _, stage in pipeline.STAGES:
        by_hand = stage(spark, by_hand, sf)
    kinds = lambda d: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in d.collect())
    assert kinds(pipeline.run(spark, sf)) == kinds(by_hand)


def test_stages_of_an_empty_table(spark, tables):
    sf, docs = tables
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), sf)
        assert out.count() == 0 and out.columns == docs.columns, name
    assert pipeline.packing(spark, docs.limit(0), sf).count() == 0


def test_stages_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == docs.columns
        assert 0 < after.count() <= before.count(), name
        before = after
    texts = [r.text for r in before.collect()]
    assert len(set(texts)) == len(texts)
    pieces = pipeline.packing(spark, before, sf).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before.collect()}
