"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer reads each word's class - insult, threat, target, negation, reported speech or
other - and three small transducers follow: negation reaches over the next words, reported speech over
the rest of its clause, a target near an insult or threat makes it directed.  Their arcs carry weights,
and their composition adds up the weights of the arcs that a word takes; the weight of a clause is the
sum along its path.  A clause with a match is toxic with the logistic of its weight, and a document if
one of its clauses is, or without a match by the constant: 1 - (1 - constant) * product(1 - clause).  So an
isolated word counts by its role in its clause and not by itself.

The insult lexicon has a seed list and is extended by word beginnings that mark toxic documents among
labelled training rows; the arcs' weights are fitted to the same rows.  Fitting reads a sample of at most
SAMPLE_TOXIC + SAMPLE_CLEAN labelled documents of FIT_BYTES (longer ones where those are few), chosen by hash; everything else
covers all rows and whole texts.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .common import OWN, crc_remainder
from .tokens import rows_of

SAMPLE_TOXIC, SAMPLE_CLEAN, FIT_BYTES, FIT_LEAST, FIT_TOTAL = 3000, 9000, 20_000, 20, 100 << 20
#: A word beginning enters the lexicon if it is in nearly only toxic sample rows, by rates, and so many
#: of them that chance among all beginnings tried doesn't explain it (a likelihood ratio).
PURITY, MARGIN = 0.97, 10.0
STEM_LENGTHS = (4, 5, 6, 7, 8)

# Seed word lists of the grammar.
INSULTS = "loser idiot pathetic scum worthless moron trash clown disgusting stupid dumb fool imbecile cretin vermin filth pig bastard jerk".split()
THREATS = "kill hurt destroy beat shoot stab burn crush töten schlagen matar golpear tuer frapper".split()
TARGETS = "you your yours u he she they them him her people those these dich dir ihr euch du tu te vous toi usted ustedes ti".split()
NEGATIONS = "not no never neither isn't aren't wasn't don't doesn't nicht kein keine nie ne pas jamais nunca".split()
REPORTS = "said says say wrote writes called calls quoted claimed reported sagte schrieb dit écrit dijo escribió".split()

#: Names of the arcs' weights; each learned word beginning is an arc of its own with its own weight besides.
WEIGHTS = ("insult", "threat", "negated", "reported", "directed")
#: Weights, the clauses' constant and the document's, where no labels tell them.
UNTAUGHT = (1.0, 1.0, -2.0, -1.0, 1.0, -1.0, -4.0)
_CLAUSE = re.compile(r"[.,;:!?\n|]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


class Transducer:
    """Deterministic: step[state, symbol] is (next state, output, names of the arc's weights); a missing
    pair keeps the state and writes the symbol without a weight."""

    def __init__(self, start, step: dict):
        self.start, self.step = start, step

    def move(self, state, symbol):
        return self.step.get((state, symbol), (state, symbol, ()))


def compose(symbols: list[str], *machines: Transducer) -> Transducer:
    """The machine over symbols that feeds each one's output to the next; an arc has the weights of all arcs that it
    stands for, and states are reached ones only."""
    start = tuple(m.start for m in machines)
    step, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in symbols:
            x, after, weights = symbol, [], ()
            for m, s in zip(machines, state):
                s, x, w = m.move(s, x)
                after.append(s)
                weights += w
            step[state, symbol] = (tuple(after), x, weights)
            if tuple(after) not in seen:
                seen.add(tuple(after))
                todo.append(tuple(after))
    return Transducer(start, step)


def lexicon(stems: list[str]) -> Transducer:
    """Insults of the seed list, threats, and each learned word beginning, which is an insult with its own weight."""
    return Transducer(0, {(0, "I"): (0, "I", ("insult",)), (0, "T"): (0, "T", ("threat",))} | {(0, s): (0, "I", (s,)) for s in stems})


def negation(reach: int = 3) -> Transducer:
    """After a negation insults and threats among the next `reach` words are negated and settled (x)."""
    step = {(0, "N"): (reach, "o", ())}
    for k in range(1, reach + 1):
        step |= {(k, "N"): (reach, "o", ()), (k, "I"): (k - 1, "x", ("negated",)), (k, "T"): (k - 1, "x", ("negated",))}
        step |= {(k, c): (k - 1, c, ()) for c in "YoR"}
    return Transducer(0, step)


def reported() -> Transducer:
    """After a verb of speech the clause's insults and threats are reported and settled."""
    return Transducer(0, {(0, "R"): (1, "o", ()), (1, "R"): (1, "o", ()), (1, "I"): (1, "x", ("reported",)), (1, "T"): (1, "x", ("reported",))})


def directed(reach: int = 4) -> Transducer:
    """An insult or threat within `reach` words after a target is directed at it."""
    step = {(0, "Y"): (reach, "o", ())}
    for k in range(1, reach + 1):
        step |= {(k, "Y"): (reach, "o", ()), (k, "I"): (reach, "x", ("directed",)), (k, "T"): (reach, "x", ("directed",)), (k, "o"): (k - 1, "o", ())}
    return Transducer(0, step)


class Grammar:
    """Lexicon and composed transducer; clauses() gives how often each of `names` is on the path of a clause."""

    def __init__(self, stems: list[str], insults: list[str] | None = None):
        import ahocorasick

        self.classes = {w: c for c, ws in (("R", REPORTS), ("N", NEGATIONS), ("Y", TARGETS), ("T", THREATS), ("I", insults or INSULTS)) for w in ws}
        self.stems = {n: {s for s in stems if len(s) == n} for n in {len(s) for s in stems}}
        self.names = (*WEIGHTS, *stems)
        machine = compose([*"ITYNRo", *stems], lexicon(stems), negation(), reported(), directed())
        self.start = machine.start
        place = {w: k for k, w in enumerate(self.names)}
        self.step = {k: (state, [place[w] for w in weights]) for k, (state, _, weights) in machine.step.items()}
        self.spotter = ahocorasick.Automaton()
        for w in {*(insults or INSULTS), *THREATS, *stems}:
            self.spotter.add_word(w, len(w))
        self.spotter.make_automaton()

    def word_class(self, word: str) -> str:
        if c := self.classes.get(word):
            return c
        return next((word[:n] for n, known in self.stems.items() if word[:n] in known), "o")

    def clauses(self, text: str) -> list[list[int]]:
        """Counts by names of each clause with a match; clauses without any are never cut into words."""
        out = []
        low = text.lower()
        done = -1
        for end, _size in self.spotter.iter(low):
            if end <= done:
                continue
            first = max(low.rfind(c, max(done, 0), end) for c in ".,;:!?\n|") + 1  # the last clause's end is a mark
            after = _CLAUSE.search(low, end)
            done = after.start() if after else len(low)
            state, path = self.start, [0] * len(self.names)
            for m in _WORD.finditer(low, first, done):
                state, weights = self.step[state, self.word_class(m[0])]
                for w in weights:
                    path[w] += 1
            if any(path):
                out.append(path)
        return out


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def document_scores(paths: np.ndarray, row: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Scores of n documents from their clauses: paths (one row a clause) and each one's document."""
    clause = _logistic(paths @ weights[:-2] + weights[-2])
    clean = np.bincount(row, np.log1p(-np.minimum(clause, 1 - 1e-12)), n) + np.log1p(-_logistic(weights[-1]))
    return -np.expm1(clean)


def stacked(found: list[list[list[int]]], names: int) -> tuple[np.ndarray, np.ndarray]:
    """Clauses of all documents, and the document of each."""
    paths = np.array([p for doc in found for p in doc], float).reshape(-1, names)
    return paths, np.repeat(np.arange(len(found)), [len(doc) for doc in found])


def without_copies(texts: list[str], share: float = 0.3) -> list[int]:
    """Places of texts less than `share` of whose 3-word shingles (every eighth by hash) came before, so
    copies of one toxic document don't make its other words look toxic."""
    seen: set[int] = set()
    kept = []
    for k, text in enumerate(texts):
        w = text.encode("utf-8", "replace").split()
        own = {h for h in (zlib.crc32(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))) if h % 8 == 0}
        if len(own & seen) <= share * len(own):
            kept.append(k)
        seen |= own
    return kept


def learn_stems(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Shortest word beginnings that mark toxic rows."""
    seen = [Counter(), Counter()]
    for text, y in zip(texts, toxic):
        words = set(_WORD.findall(text.lower()))
        seen[int(y)].update({w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n})
    rows = [max(1, int((toxic == k).sum())) for k in (0, 1)]
    share = rows[1] / sum(rows)
    needed = 2 * math.log(1 + len(seen[0].keys() | seen[1].keys())) + MARGIN

    def marks(s: str) -> bool:
        n1, n0 = seen[1][s], seen[0][s]
        if n1 / rows[1] < PURITY * (n1 / rows[1] + n0 / rows[0]):
            return False
        ratio = 2 * n1 * math.log(n1 / ((n1 + n0) * share)) + (2 * n0 * math.log(n0 / ((n1 + n0) * (1 - share))) if n0 else 0)
        return ratio >= needed

    found: list[str] = []
    for s in sorted(filter(marks, seen[1]), key=lambda s: (len(s), s)):
        if not any(s[:n] in found for n in STEM_LENGTHS if n < len(s)):
            found.append(s)
    return found


def fit_weights(paths: np.ndarray, row: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 3000, rate: float = 0.05) -> np.ndarray:
    """Weights of least ridge-penalised log loss of the documents, by gradient steps of adapted length."""
    w = np.array([*UNTAUGHT[:-2], *[0.0] * (paths.shape[1] - len(WEIGHTS)), *UNTAUGHT[-2:]])
    first, second = np.zeros_like(w), np.zeros_like(w)
    x = np.hstack([paths, np.ones((len(paths), 1))])
    for k in range(1, rounds + 1):
        p = np.clip(document_scores(paths, row, len(y), w), 1e-12, 1 - 1e-12)
        # the loss by the log of a document's chance to be clean
        d = np.where(y > 0, -(1 - p) / p, 1.0)
        g = np.append(x.T @ (d[row] * _logistic(x @ w[:-1])), (d * _logistic(w[-1])).sum()) + ridge * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-9)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    return w


def chosen_rows(text: DataFrame, y: DataFrame) -> list[tuple]:
    """(id, hash of the text, label) of the rows to learn from, among documents that have a label.

    Of each class by hash of the identifier, at most SAMPLE_TOXIC or SAMPLE_CLEAN among texts of FIT_BYTES.  Where
    these are fewer than FIT_LEAST, those of up to twice the length are taken too, and so on, as far as FIT_TOTAL bytes
    a class go, but one at least.
    """
    keys = text.filter(F.col(OWN + "id").isNotNull()).select(OWN + "id", "hash", F.octet_length("text").alias("size")).distinct().join(y, OWN + "id")
    keys = keys.withColumn("longer", F.coalesce(F.greatest(F.ceil(F.log2(F.col("size") / FIT_BYTES)), F.lit(0)), F.lit(0)))
    order = [F.col("longer"), F.xxhash64(OWN + "id"), F.col(OWN + "id"), F.col("hash")]
    out = []
    for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        total, reached = 0, 0
        for k, r in enumerate(keys.filter(F.col("y") == label).orderBy(*order).limit(most).collect()):
            total += r["size"]
            if k and total > FIT_TOTAL or k >= FIT_LEAST and r["longer"] > reached:
                break
            reached = r["longer"]
            out.append((r[OWN + "id"], r["hash"], label))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0) -> dict:
    """The model as plain values: stems and weights, from rows whose crc remainder isn't held_out."""
    y = labels.select(F.col(id_col).alias(OWN + "id"), F.col("toxic").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (crc_remainder(F.col(OWN + "id"), folds) != held_out))
    y = y.groupBy(OWN + "id").agg(F.max("y").alias("y"))
    text = docs.select(F.col(id_col).alias(OWN + "id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    chosen = chosen_rows(text, y)
    if not chosen:
        return {"stems": [], "weights": list(UNTAUGHT)}
    # a text a chosen pair, whose number and bytes are bounded, however often rows repeat
    wanted = docs.sparkSession.createDataFrame(chosen, T.StructType([text.schema[OWN + "id"], text.schema["hash"], T.StructField("y", T.IntegerType())]))
    rows = text.join(F.broadcast(wanted), [OWN + "id", "hash"]).dropDuplicates([OWN + "id", "hash"]).select(OWN + "id", "text", "y").toArrow().sort_by([(OWN + "id", "ascending"), ("text", "ascending")])
    toxic = rows.column("y").to_numpy().astype(int)
    texts = rows.column("text").to_pylist()
    if not len(toxic) or toxic.min() == toxic.max():
        return {"stems": [], "weights": list(UNTAUGHT)}
    # two thirds of the rows choose the stems and the others the weights, so stems that fit by chance get none
    half = np.arange(len(toxic)) % 3 != 0
    apart = [k for k in without_copies(texts) if half[k]]
    stems = learn_stems([texts[k] for k in apart], toxic[apart])
    grammar = Grammar(stems)
    others = np.flatnonzero(~half)
    w = fit_weights(*stacked([grammar.clauses(texts[k]) for k in others], len(grammar.names)), toxic[others].astype(float))
    return {"stems": stems, "weights": w.tolist()}


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0, threshold: float = 0.5, keep_columns: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted and paths.

    paths: how often each arc's weight is on the paths of the document's clauses, as JSON.  Only the text
    enters a score.  A null text counts as empty; an empty text has no match and gets the score of the
    constant.  Where labels clash, a document that any row marks toxic is toxic.  Without documents of both
    classes among the rows that may be learned from, the seed lists and the weights UNTAUGHT are used.
    Identifiers that repeat among documents are learned from with each of their texts, once each.  A null
    identifier's remainder is that of empty text, and no label is its.  Repeated rows are scored each; an empty table gives an empty result; labels of other documents, null labels and an
    empty label table are allowed.  With keep_columns, docs' own columns come with toxic_score and
    toxic_predicted added.
    """
    spark = docs.sparkSession
    ship(spark)
    model = json.dumps(fit(docs, labels, id_col, text_col, folds, held_out))
    if keep_columns:
        source = docs.drop(*[c for c in ("toxic_score", "toxic_predicted") if c in docs.columns])
        names = ("toxic_score", "toxic_predicted")
        schema = T.StructType([*source.schema.fields, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_predicted", T.IntegerType())])
    else:
        source = docs.select(F.col(id_col).alias("doc_id"), (crc_remainder(F.col(id_col), folds) == held_out).alias("held_out"), F.col(text_col).alias(OWN + "text"))
        schema = T.StructType([*source.drop(OWN + "text").schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("paths", T.StringType())])

    def run(batches):
        m = json.loads(model)
        grammar, weights = Grammar(m["stems"]), np.array(m["weights"])
        name = text_col if keep_columns else OWN + "text"
        for batch in batches:
            found = [grammar.clauses(t or "") for (t,) in rows_of(batch, name)]
            score = document_scores(*stacked(found, len(grammar.names)), len(found), weights)
            predicted = pa.array((score >= threshold).astype(np.int32))
            if keep_columns:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), predicted], [*batch.schema.names, *names])
            else:
                said = pa.array([json.dumps({w: n for w, n in zip(grammar.names, map(sum, zip(*doc))) if n}) for doc in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), predicted, said], schema.names)

    return source.mapInArrow(run, schema)
