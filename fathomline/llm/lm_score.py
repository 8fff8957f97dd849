"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Word counts of all training documents are gathered once.  The most frequent words have embeddings of
their own, more of them the larger the vocabulary; all others share one per ending (last two bytes).  The
model predicts a token in two steps from the two before it: first one of HEAD frequent words or a class of
endings, then, within a class, one of its own words or the class's other words together; among those
others a word has its smoothed share.  So each word, seen or not, has a normalised probability.

Both steps are log-bilinear: the sum of the two context embeddings times an output embedding, plus a
bias.  They are trained in numpy against noise drawn from the frequencies, on every token of every training
document: in each round every task goes on from the same weights over its documents of that round, and the
tasks' weights are averaged by their tokens.  Tokens of one context meet the same noise as one row, times
their number, which gives the same gradient.  Texts are cut into words twice: to count words, and to number them
for training and scores.  For scores, matrix products over batches of tokens give all
alternatives of a step at once, so each probability has its exact normaliser; contexts that occur more
than once among the texts of a slice have it computed once.

Words beyond the HOT most frequent ones get their counts by a join, the others by lookup; a document's
words are counted before that join, so a word that no training document has is one row a document.
"""

from __future__ import annotations

import functools
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import drop_path, materialise, scratch_path, ship, small_batches
from .common import OWN, crc_remainder
from .tokens import rows_of

#: Words whose counts are sent to each task; a proven bound of that table.
HOT = 200_000
#: Classes of word endings, and the most frequent words, which the first step predicts by themselves.
ENDINGS, HEAD, DIM = 128, 128, 32
#: Least number of words with embeddings, where there are so many.
OWN_WORDS = 4096
#: Tokens that a task trains on, at least, and tasks at most; so weights that tasks pass on stay small beside the input.
TASK_TOKENS, TASKS = 8_000_000, 256
#: Tokens that a task holds and shuffles at a time while it trains.
CHUNK = 1 << 20
#: Bytes of texts that are cut into words together, where a longer text is by itself, and tokens that are scored together.
TOGETHER, SCORED = 3 << 20, 1 << 20
#: Parts that the weights are cut into to be averaged.
SLICES = 64
NOISE, BATCH, RATE = 128, 1024, 0.15
#: Tokens of one context that are learned from together.
SAME = 4
#: Passes over the training tokens, each in ROUNDS parts by hash, after each of which weights are averaged.
EPOCHS, ROUNDS = 1, 3
#: Scores of one matrix product, which then stay in a core's cache.
IN_CACHE = 1 << 17
#: Rows that are multiplied pair by pair at a time.
ROWS = 4096
#: Sums of exponentials within these bounds have lost nothing; others are taken again from their greatest term.
LEAST_SUM, MOST_SUM = 1e-20, 1e20
#: Stands for the end of a text; no word contains white space.
END = b"\n"
FLUSH = 300_000


class Coded:
    """Texts as numbers of their distinct words: A-Z lower-cased, split at ASCII white space, then the end."""

    def __init__(self, texts: pa.Array):
        cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        found = cut.flatten().dictionary_encode()
        numbers, ends = found.indices.to_numpy(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
        # white space at either side of a text leaves an empty word there
        inside = (pc.binary_length(found.dictionary).to_numpy(zero_copy_only=False) > 0)[numbers]
        ends = np.concatenate([[0], np.cumsum(inside)])[ends]
        words = found.dictionary.cast(pa.binary())
        #: Distinct words, the end last; an empty one among them has no token.
        self.words = pa.concat_arrays([words, pa.array([END], pa.binary())])
        #: Tokens of each text, and where its first one is.
        self.lengths = np.diff(ends) + 1
        self.begins = np.cumsum(self.lengths) - self.lengths
        #: The word of each token.
        self.numbers = np.insert(numbers[inside], ends[1:], len(words))

    def distinct(self) -> list[bytes]:
        return self.words.to_numpy(zero_copy_only=False).tolist()


def parts_of(batch, column: str):
    """Slices of a batch of about TOGETHER bytes of texts each."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // TOGETHER
    begins = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for begin, end in zip(begins, [*begins[1:], len(part)]):
        yield batch.slice(begin, end - begin)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), n over the texts of OWN text: counted per task before the shuffle."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in parts_of(batch, OWN + "text"):
                coded = Coded(part.column(OWN + "text"))
                n = np.bincount(coded.numbers, minlength=len(coded.words))
                held.append(pa.table([coded.words, pa.array(n)], ["word", "n"]).filter(pa.array(n > 0)))
                size += len(held[-1])
                if size > 2 * FLUSH:
                    held = [summed(held)]
                    size = len(held[0])
                    if size > FLUSH:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from summed(held).to_batches()

    def summed(held):
        found = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
        return pa.table([found["word"], found["n_sum"]], ["word", "n"])

    return docs.select(OWN + "text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def least_hot_count(counts: DataFrame) -> float:
    """The least count whose words, together with all more frequent ones, are at most HOT.

    Words are counted by steps of a sixteenth of an octave, of which there are under a thousand, so no
    task sorts the vocabulary.
    """
    step = F.floor(F.log2("n") * 16)
    left = HOT
    least = float("inf")
    for s, words in sorted(counts.groupBy(step).count().collect(), reverse=True):
        left -= words
        if left < 0:
            break
        least = 2 ** (s / 16) * (1 - 1e-12)
    return least


def ending_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def own_words(distinct: int) -> int:
    """Words with embeddings: they grow as the square root of the vocabulary, up to the words sent to tasks."""
    return min(HOT, max(OWN_WORDS, int(10 * distinct**0.5)))


class Units:
    """Numbers of what has an embedding: own words by rank, then the classes of endings, then the start.

    The first HEAD ranks are predicted by the first step itself, as are the classes; the others by the
    second step within their class, where number own + c stands for all other words of class c.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, ending_counts: np.ndarray):
        """words: own words by rank; ending_counts: tokens of all words by class."""
        self.own, self.head = len(words), min(HEAD, len(words))
        self.start = self.own + ENDINGS
        ending = np.array([ending_class(w) for w in words], np.int64)
        #: What the first step predicts for a unit: a class, or a frequent word after the classes.
        self.first = np.concatenate([ENDINGS + np.arange(self.head), ending[self.head :], np.arange(ENDINGS)]).astype(np.int64)
        rest = ending_counts - np.bincount(ending, counts, ENDINGS)
        self.frequency = np.concatenate([counts, rest])
        self.first_frequency = np.bincount(self.first, self.frequency, ENDINGS + self.head)
        inner = np.arange(self.head, self.start)
        #: The units that the second step chooses from, by class; the others of the class come last.
        self.members = [inner[self.first[inner] == c] for c in range(ENDINGS)]

        #: A unit's place in its class, and how many the class has.
        self.place, self.sizes = np.zeros(self.start, np.int64), np.array([len(m) for m in self.members])
        for m in self.members:
            self.place[m] = np.arange(len(m))

    def inner(self, unit: np.ndarray) -> np.ndarray:
        """Places of the units that the second step predicts, sorted by class, which have a choice there."""
        c = self.first[unit]
        at = np.flatnonzero(unit >= self.head)
        at = at[self.sizes[c[at]] > 1]
        return at[np.argsort(c[at].astype(np.uint16), kind="stable")]

    def runs(self, unit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted places, where each class begins, and the classes."""
        c = self.first[unit[at]]
        begins = np.flatnonzero(np.diff(c, prepend=-1))
        return begins, c[begins]


def _smoothed(counts: np.ndarray) -> np.ndarray:
    return (counts + 0.5) / (counts + 0.5).sum()


class LogBilinear:
    """Two context tables and the outputs of both steps; all are float32 tables with a row per unit."""

    def __init__(self, units: Units, seed: int = 7):
        self.units = units
        self.rng = np.random.default_rng(seed)
        n = units.start
        new = lambda rows: self.rng.normal(0, 0.1, (rows, DIM)).astype(np.float32)
        inner = units.frequency.copy()
        inner[: units.head] = -0.5  # the second step never gives these
        chance = [_smoothed(units.first_frequency), _smoothed(inner)]
        outputs = [np.hstack([new(len(p)), np.log(np.maximum(p, 1e-30)).astype(np.float32)[:, None]]) for p in chance]
        #: Context embeddings of the older and then the newer token, and both steps' outputs with their biases last.
        self.stacked = [new(2 * (n + 1)), np.concatenate(outputs)]
        self.past = [np.ones(len(t), np.float32) for t in self.stacked]
        self.second = len(chance[0])
        #: The same by token and by step.
        self.tables = [x for t, k in zip(self.stacked, (n + 1, self.second)) for x in (t[:k], t[k:])]
        #: Each step's outputs to draw from with their cumulated chances, and the logarithm of how often each is drawn for a batch.
        self.noise = [(np.flatnonzero(p) + k, np.cumsum(p[p > 0])) for p, k in zip(chance, (0, self.second))]
        self.log_drawn = np.log(np.maximum(NOISE * np.concatenate(chance), 1e-30)).astype(np.float32)
        self.slot = np.empty(max(map(len, self.stacked)), np.int64)

    def _added_up(self, rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct rows and the sums of their gradients."""
        at, slot = np.arange(len(rows)), self.slot
        slot[rows] = at  # of equal rows one stays
        stays = slot.take(rows) == at
        first, again = np.flatnonzero(stays), np.flatnonzero(~stays)
        distinct, total, width = rows.take(first), grad.take(first, 0), grad.shape[1]
        slot[distinct] = at[: len(first)]
        to = slot.take(rows.take(again))[:, None] * width + np.arange(width)
        np.add.at(total.reshape(-1), to.ravel(), grad.take(again, 0).ravel())
        return distinct, total

    def _step(self, k: int, rows: np.ndarray, grad: np.ndarray) -> None:
        """Adagrad by row of a stacked table; rows may repeat."""
        rows, grad = self._added_up(rows, grad)
        past = self.past[k].take(rows) + np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
        self.past[k][rows] = past
        grad *= (RATE / np.sqrt(past))[:, None]
        self.stacked[k][rows] = np.subtract(self.stacked[k].take(rows, 0), grad, out=grad)

    def _query(self, older: np.ndarray, newer: np.ndarray) -> np.ndarray:
        """What outputs are multiplied with: the sum of the contexts' embeddings, and 1 for the bias."""
        q = np.empty((len(older), DIM + 1), np.float32)
        q[:, DIM] = 1
        np.add(self.tables[0].take(older, 0), self.tables[1].take(newer, 0), out=q[:, :DIM])
        return q

    def _contrast(self, q: np.ndarray, of: np.ndarray, inner: np.ndarray, target: np.ndarray, noise: np.ndarray) -> np.ndarray:
        """Tell targets from the same noise for all of them; moves the outputs, gives the gradient of q.

        q has a row per context and `of` the context of each token: first of every context's first token, then of the
        second ones of those that have one, and so on, the contexts with most tokens being first.  Targets are the
        first step's output for each token, then the second's for the tokens at `inner`; noise has NOISE of
        either.  Against noise the tokens of a context are alike, so their sum is one product times their number.
        The logistic function of x is half of 1 + tanh(x / 2), so its sums follow from those of tanh.
        """
        n, outputs = len(of), self.stacked[1]
        far = outputs.take(noise, 0)
        half = far * np.float32(0.5)
        half[:, DIM] -= self.log_drawn.take(noise) * np.float32(0.5)
        half = np.ascontiguousarray(half.T)
        of_inner = of.take(inner)
        many = np.stack([np.bincount(x, minlength=len(q)) for x in (of, of_inner)], 1).astype(np.float32)
        grad = np.empty((len(target) + len(noise), DIM + 1), np.float32)
        of_noise, gq = grad[len(target) :], many @ far.reshape(2, NOISE, DIM + 1).sum(1)
        of_noise.reshape(2, NOISE, DIM + 1)[...] = (many.T @ q)[:, None]
        step = -(-len(q) // -(-len(q) * len(far) // IN_CACHE))
        for i in range(0, len(q), step):
            k = slice(i, i + step)
            false = q[k] @ half
            np.tanh(false, out=false)
            by_step = false.reshape(len(false), 2, NOISE)
            by_step *= many[k, :, None]
            gq[k] += false @ far
            of_noise += false.T @ q[k]
        x, own = q.take(np.concatenate([of, of_inner]), 0), outputs.take(target, 0)
        true = np.tanh((np.einsum("ij,ij->i", x, own) - self.log_drawn.take(target)) * np.float32(0.5)) - 1
        own *= true[:, None]
        np.multiply(true[:, None], x, out=grad[: len(target)])
        grad *= np.float32(0.5)
        self._step(1, np.concatenate([target, noise]), grad)
        own[inner] += own[n:]
        begins = np.flatnonzero(of == 0).tolist()
        for i, j in zip(begins, [*begins[1:], n]):
            gq[: j - i] += own[i:j]
        gq *= np.float32(0.5)
        return gq[:, :DIM]

    def train(self, older: np.ndarray, newer: np.ndarray, unit: np.ndarray) -> None:
        """Noise-contrastive estimation over all tokens once, in batches of shuffled order.

        Tokens of one context, up to SAME of them, are in a batch together, where their context is multiplied
        with the noise once.  The second step is taught to tell a unit from those of all classes, which teaches it to
        tell it from those of its class.
        """
        context = older * (self.units.start + 1) + newer
        # by unit too, so the order of texts is of no account
        order = np.argsort(context * self.units.start + unit)
        sizes = np.diff(np.flatnonzero(_fresh(context.take(order))), append=len(order))
        groups, place = -(-sizes // SAME), _places(sizes)
        # a context's tokens are dealt to its groups in turn
        place, turn = np.divmod(place, np.repeat(groups, sizes))
        group = np.repeat(np.cumsum(groups) - groups, sizes) + turn
        sizes = np.bincount(group)
        shuffled = self.rng.permutation(len(sizes))
        batch = (np.cumsum(sizes.take(shuffled)) - 1) // BATCH
        shuffled = shuffled.take(np.lexsort((-sizes.take(shuffled), batch)))
        rank = np.empty_like(shuffled)
        rank[shuffled] = np.arange(len(shuffled))
        sizes, group = sizes.take(shuffled), rank.take(group)
        by_place = np.argsort((batch.take(group) * SAME + place) * len(sizes) + group)
        order, group = order.take(by_place), group.take(by_place)
        older, newer, unit = older.take(order), newer.take(order) + (self.units.start + 1), unit.take(order)
        inner, first = np.flatnonzero(unit >= self.units.head), self.units.first.take(unit)
        groups = np.append(np.flatnonzero(_fresh(batch)), len(batch))
        tokens = np.append(0, np.cumsum(sizes))[groups]
        inners = np.searchsorted(inner, tokens)
        noise = np.hstack([units.take(np.searchsorted(ends[:-1], self.rng.random((len(groups) - 1, NOISE)))) for units, ends in self.noise])
        for k, (g, h, i, j, u, v) in enumerate(zip(groups, groups[1:], tokens, tokens[1:], inners, inners[1:])):
            rows = np.concatenate([older[i : i + h - g], newer[i : i + h - g]])
            q = np.ones((h - g, DIM + 1), np.float32)
            both = self.stacked[0].take(rows, 0)
            np.add(both[: h - g], both[h - g :], out=q[:, :DIM])
            gq = self._contrast(q, group[i:j] - g, inner[u:v] - i, np.concatenate([first[i:j], unit[inner[u:v]] + self.second]), noise[k])
            self._step(0, rows, np.concatenate([gq, gq]))

    def log_probability(self, older: np.ndarray, newer: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Natural logarithm of each unit's normalised probability after its two."""
        blocks = [slice(i, i + SCORED) for i in range(0, len(unit), SCORED)]
        return np.concatenate([np.empty(0), *(self._log_probability(older[k], newer[k], unit[k]) for k in blocks)])

    def _log_probability(self, older: np.ndarray, newer: np.ndarray, unit: np.ndarray) -> np.ndarray:
        u, (first, second) = self.units, self.tables[2:]
        # in order of contexts, as one that occurs again has the same sums
        pair = older * (u.start + 1) + newer
        order = np.argsort(pair)
        fresh = _fresh(pair.take(order))
        context, one, unit = np.cumsum(fresh) - 1, order[fresh], unit.take(order)
        q = self._query(older.take(one), newer.take(one))
        log = _scores(q, context, first, u.first.take(unit)) - self._log_sums(q, first).take(context)
        inner = u.inner(unit)
        begins, classes = u.runs(unit, inner)
        for c, at in zip(classes, np.split(inner, begins[1:])):
            outputs, of_class = second.take(u.members[c], 0), context.take(at)
            fresh = _fresh(of_class)
            sums = self._log_sums(q.take(of_class[fresh], 0), outputs)
            log[at] += _scores(q, of_class, outputs, u.place.take(unit.take(at))) - sums.take(np.cumsum(fresh) - 1)
        out = np.empty(len(unit))
        out[order] = log
        return out

    @staticmethod
    def _log_sums(q: np.ndarray, outputs: np.ndarray) -> np.ndarray:
        """Logarithm of the sum of the exponentials of each row's scores."""
        powers, log = np.ascontiguousarray(outputs.T) * np.float32(1 / np.log(2)), np.empty(len(q))
        ones, step = np.ones(len(outputs), np.float32), max(1, IN_CACHE // len(outputs))
        for i in range(0, len(q), step):
            scores = q[i : i + step] @ powers
            with np.errstate(over="ignore"):
                sums = np.exp2(scores, out=scores) @ ones
            lost = np.flatnonzero(~((sums > LEAST_SUM) & (sums < MOST_SUM)))
            sums[lost] = 1
            log[i : i + step] = np.log(sums)
            if len(lost):
                scores = (q[i + lost] @ outputs.T).astype(np.float64)
                top = scores.max(1)
                log[i + lost] = top + np.log(np.exp(scores - top[:, None]).sum(1))
        return log

    def state(self) -> np.ndarray:
        """Weights, then sums of squared gradients, in one vector."""
        return np.concatenate([x.ravel() for x in (*self.stacked, *self.past)])

    def restore(self, state: np.ndarray) -> None:
        at = 0
        for x in (*self.stacked, *self.past):
            x[...] = state[at : at + x.size].reshape(x.shape)
            at += x.size


def _fresh(ordered: np.ndarray) -> np.ndarray:
    """Which of some ordered numbers differ from the one before."""
    fresh = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    return fresh


def _places(sizes: np.ndarray) -> np.ndarray:
    """The numbers from 0 within groups of these sizes, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _scores(q: np.ndarray, rows: np.ndarray, outputs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Products of rows of q and of outputs, pair by pair."""
    out = np.empty(len(rows))
    for i in range(0, len(rows), ROWS):
        k = slice(i, i + ROWS)
        out[k] = np.einsum("ij,ij->i", q.take(rows[k], 0), outputs.take(places[k], 0))
    return out


@functools.cache
def _class_table() -> np.ndarray:
    """The class of each ending of two bytes, then of each one of one byte."""
    return np.array([ending_class(bytes(x)) for x in (*itertools.product(range(256), repeat=2), *zip(range(256)))])


def ending_classes(words: pa.BinaryArray) -> np.ndarray:
    """The class of each word; any number for an empty one."""
    ends, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][: len(words) + 1], np.frombuffer(words.buffers()[2], np.uint8)
    last, before = data.take(ends[1:] - 1, mode="wrap").astype(np.int64), data.take(ends[1:] - 2, mode="wrap").astype(np.int64)
    return _class_table().take(np.where(np.diff(ends) > 1, before * 256 + last, 65536 + last))


def coded_texts(docs: DataFrame, shared) -> DataFrame:
    """Per document its units as signed 32-bit integers, the round that it is learned in, and all of its scores
    that the model has no part in: of the hot words and of words' shares of their class; words beyond the hot ones
    come as an array with their counts."""

    def run(batches):
        t = shared.value
        place = {w: k for k, w in enumerate(t["words"])}
        logs, within, own = np.append(t["log"], 0.0), t["within"], t["own"]
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in parts_of(batch, OWN + "text"):
                coded = Coded(part.column(OWN + "text"))
                # by distinct word: its place among the hot ones, its unit, its part of both scores
                at = np.array([place.get(w, -1) for w in coded.distinct()], np.int64)
                far = (at < 0) | (at >= own)
                ending = ending_classes(coded.words)
                unit = np.where(far, own + ending, at).astype(np.int32)
                base = logs[at]  # none for a word that isn't hot
                # an own word is its unit; others have their smoothed share of their class
                share = np.where(far, base - within[ending], 0.0)
                streams = [x.tobytes() for x in np.split(unit[coded.numbers], coded.begins[1:])]
                hot, hot_log, share_log = (np.add.reduceat(x[coded.numbers], coded.begins) for x in ((at >= 0).astype(np.int64), base, share))
                rows = np.arange(row, row + len(part))
                row += len(part)
                names = ["row", "doc_id", "held_out", "part", "n_tokens", "hot_known", "hot_log", "share_log", "rare", "units"]
                yield pa.RecordBatch.from_arrays([pa.array(rows), *map(part.column, names[1:4]), *map(pa.array, (coded.lengths, hot, hot_log, share_log)), rare_words(coded, at), pa.array(streams, pa.binary())], names)

    def rare_words(coded, at):
        """Per text an array of its words beyond the hot ones and how often it has each."""
        text = np.repeat(np.arange(len(coded.lengths)), coded.lengths)
        rare = at[coded.numbers] < 0
        found, n = np.unique(text[rare] * len(at) + coded.numbers[rare], return_counts=True)
        ends = np.searchsorted(found, np.arange(len(coded.lengths) + 1) * len(at))
        pairs = pa.StructArray.from_arrays([coded.words.take(pa.array(found % len(at))), pa.array(n.astype(np.int64))], ["word", "n"])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs)

    # by identifier and not by content, as copies should be spread over the rounds
    part = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col(OWN + "text"))), F.lit(ROUNDS)).cast("int")
    schema = "row long, doc_id long, held_out boolean, part int, n_tokens long, hot_known long, hot_log double, share_log double, rare array<struct<word:binary,n:long>>, units binary"
    return docs.select("doc_id", "held_out", part.alias("part"), OWN + "text").mapInArrow(run, schema)


def contexts(streams: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two units before each token, and its own."""
    if not streams:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    before = np.full(2, start)
    padded = np.concatenate([x for s in streams for x in (before, s)]).astype(np.int64)
    ends = np.cumsum([len(s) + 2 for s in streams])
    inside = np.ones(len(padded), bool)
    inside[np.concatenate([[0], ends[:-1]])] = inside[np.concatenate([[0], ends[:-1]]) + 1] = False
    at = np.flatnonzero(inside)
    return padded[at - 2], padded[at - 1], padded[at]


def train_everywhere(streams: DataFrame, units: Units, total: int) -> LogBilinear:
    """The model trained on all streams, which have `total` tokens."""
    spark = streams.sparkSession
    model = LogBilinear(units)
    streams = streams.coalesce(max(1, min(TASKS, -(-total // TASK_TOKENS))))
    for epoch in range(EPOCHS if total else 0):
        learned = 0
        for part in range(ROUNDS):
            start = spark.sparkContext.broadcast((units, model.state()))
            path = scratch_path(spark, "lm-weights")
            _trained_slices(streams.filter(F.col("part") == part), start, (epoch, part)).write.parquet(path)
            parts = spark.read.schema(SLICE).parquet(path)
            tokens = parts.filter("slice = 0").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
            if tokens:
                sums = sorted(_added(parts.repartition(SLICES, "slice")).collect())
                model.restore((np.concatenate([np.frombuffer(r["weights"], np.float64) for r in sums]) / tokens).astype(np.float32))
            learned += tokens
            start.unpersist()
            drop_path(spark, path)
        if learned != total:
            raise RuntimeError(f"the model learned from {learned} of {total} training tokens")
    return model


SLICE = "slice int, tokens long, weights binary"


def _trained_slices(streams: DataFrame, start, seed: tuple) -> DataFrame:
    """Per task the tokens that it learned from, all of its own, and the weights that it came to, in slices."""

    def run(batches):
        units, state = start.value
        model = LogBilinear(units)
        model.restore(state)
        model.rng = np.random.default_rng([*seed, TaskContext.get().partitionId()])
        tokens, waiting, held = 0, [], 0
        for batch in batches:
            for (s,) in rows_of(batch, "units"):
                waiting.append(np.frombuffer(s, np.int32))
                held += len(waiting[-1])
                if held >= CHUNK:
                    model.train(*contexts(waiting, units.start))
                    tokens, waiting, held = tokens + held, [], 0
        if held:
            model.train(*contexts(waiting, units.start))
        tokens += held
        if tokens:
            for k, part in enumerate(np.array_split(model.state(), SLICES)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([tokens], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["slice", "tokens", "weights"])

    return streams.select("units").mapInArrow(run, SLICE)


def _added(parts: DataFrame) -> DataFrame:
    """The sum of each slice's rows, which one task has, times their tokens."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n, w in rows_of(batch, "slice", "tokens", "weights"):
                x = np.frombuffer(w, np.float32).astype(np.float64) * n
                total[k] = total[k] + x if k in total else x
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["slice", "weights"])

    return parts.mapInArrow(run, "slice int, weights binary")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Documents whose crc remainder isn't held_out are learned from.  base_score is the add-one unigram
    log10 probability, score that of the model.  A null text counts as empty and is its end alone; a
    null identifier's remainder is that of empty text; repeated rows are scored each.  Without any
    training document all counts are zero and all words unknown.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_remainder(F.col(id_col), folds) == held_out).alias("held_out"), F.col(text_col).cast("string").alias(OWN + "text"))
    train = read.filter(~F.col("held_out"))
    with small_batches(spark):
        counts = materialise(word_counts(train), "lm-counts")
    units, hot, total, distinct = lay_out(counts)
    coded = _coded(read, units, hot)
    model = train_everywhere(coded.filter(~F.col("held_out")), units, total)
    shared = spark.sparkContext.broadcast((units, model.state()))
    with small_batches(spark):
        partial = materialise(_model_scores(coded, shared), "lm-partial")
    rare = coded.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("tf"))
    known = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("rare_log"), F.sum("tf").alias("rare_known"))
    n, base_unit = F.col("n_tokens"), float(np.log10(total + distinct + 1))
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return partial.join(known, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("hot_log") + rare_log - n * F.lit(base_unit)).alias("base_score"), (F.col("model_log") + rare_log).alias("score"),
    )


def fit(spark, train: DataFrame, counts: DataFrame) -> tuple[LogBilinear, dict, int, int]:
    """The trained model, what tasks need of the hot words, and the numbers of training tokens and words."""
    units, hot, total, distinct = lay_out(counts)
    coded = _coded(train.withColumn("held_out", F.lit(False)), units, hot)
    return train_everywhere(coded, units, total), hot, total, distinct


def lay_out(counts: DataFrame) -> tuple[Units, dict, int, int]:
    """What has an embedding, what tasks need of the hot words, and the numbers of training tokens and words."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    found = counts.filter(F.col("n") >= least_hot_count(counts)).toArrow()  # at most HOT rows
    words, n = [bytes(w) for w in found.column("word").to_pylist()], found.column("n").to_numpy().astype(np.float64)
    order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
    words, n = [words[k] for k in order], n[order]
    own = words[: own_words(distinct)]
    ending = (F.crc32(F.expr("substring(word, -2, 2)")) % ENDINGS).cast("int")
    ending_counts, members = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for c, tokens, kinds in counts.groupBy(ending).agg(F.sum("n"), F.count(F.lit(1))).collect():
        ending_counts[c], members[c] = tokens, kinds
    units = Units(own, n[: len(own)], ending_counts)
    members -= np.bincount([ending_class(w) for w in own], minlength=ENDINGS) if own else 0
    # an unseen word counts once in its class, and so does each seen one more
    within = np.log10(units.frequency[units.own :] + members + 1)
    return units, {"words": words, "log": np.log10(n + 1), "within": within}, total, distinct


def _coded(docs: DataFrame, units: Units, hot: dict) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(hot | {"own": units.own})
    with small_batches(spark):
        return materialise(coded_texts(docs, shared), "lm-coded")


def _model_scores(coded: DataFrame, shared) -> DataFrame:
    """Per document the model's part of its score added to the words' shares of their class."""
    names = ["row", "doc_id", "held_out", "n_tokens", "hot_known", "hot_log"]

    def run(batches):
        units, state = shared.value
        model = LogBilinear(units)
        model.restore(state)
        for part in slices(batches):
            lengths = part.column("n_tokens").to_numpy()
            chance = model.log_probability(*contexts([np.frombuffer(s, np.int32) for s in part.column("units").to_pylist()], units.start)) / np.log(10)
            model_log = np.add.reduceat(chance, np.cumsum(lengths) - lengths) + part.column("share_log").to_numpy()
            yield from pa.table([*map(part.column, names), pa.array(model_log)], [*names, "model_log"]).to_batches()

    def slices(batches):
        """Tables of at least SCORED tokens, but for the last one."""
        waiting, held = [], 0
        for batch in batches:
            begin = 0
            for end, n in enumerate(batch.column("n_tokens").to_pylist(), 1):
                held += n
                if held >= SCORED:
                    yield pa.Table.from_batches([*waiting, batch.slice(begin, end - begin)])
                    waiting, held, begin = [], 0, end
            waiting.append(batch.slice(begin))
        if held:
            yield pa.Table.from_batches(waiting)

    return coded.select(*names, "share_log", "units").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, hot_known long, hot_log double, model_log double")
