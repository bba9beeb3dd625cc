"""Hidden Markov language model over words.

Observations are symbols: a frequent word is a symbol of its own; the other
words share ``ENDINGS`` symbols by a hash of their last bytes, and a word's
probability inside its symbol comes from its exact count in the whole training
text (plus one place for unknown words).  So the states' tables are bounded
while the vocabulary is not, and nothing is left out of a probability:

    P(text) = sum over state paths of  start x transitions x emissions  x  product of P(word | symbol)

* Training (Baum-Welch): every iteration is one pass over all training texts.
  A task adds up its expected starts, transitions and emissions; a Spark
  aggregate adds the tasks; the new parameters are a broadcast.
* Likelihood: scaled forward recursion, exact for any length.  Texts longer than
  ``SEGMENT`` symbols are cut into segments; products of their step matrices
  give exact state vectors at the cuts, so segments of all texts run side by
  side and a task holds a bounded slice.
* Word counts stay distributed.  Tasks hold at most ``KNOWN`` frequent words;
  the counts of all other words are joined to the texts that contain them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

STATES = 6
ITERATIONS = 5
#: Words whose counts every task holds, at most; those above OWN_WORDS are symbols of their own.
KNOWN, OWN_WORDS = 1 << 17, 1 << 14
#: Longer words are never held by every task, so that table is bounded in bytes too.
KNOWN_BYTES = 64
#: Symbols that the other words share.
ENDINGS = 2048
_TAIL = 3
#: Pseudo-counts: of the corpus's own symbol distribution in each state, and of every transition and start.
PRIOR, PRIOR_STEPS = 1000.0, 1.0
SEGMENT = 1024
#: Symbols whose state vectors a task holds at once, and bytes of text it splits at once.
_SLICE, _BYTES = 1 << 19, 1 << 20
_FLUSH = 500_000
_SEED = 42
_SPACE = re.compile(rb"[\t-\r ]")


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in lower case (A-Z only), in lists of about a million bytes."""
    text = text or b""
    at = 0
    while at < len(text):
        end = at + _BYTES
        if end < len(text):
            gap = _SPACE.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def ending(word: bytes) -> int:
    return zlib.crc32(word[-_TAIL:]) % ENDINGS


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, ending int, n long) of column text, all words; added up per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            got = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), pa.array([ending(w) for w in got], pa.int32()),
                                               pa.array(list(seen.values()), pa.int64())], names=["word", "ending", "n"])

        for batch in batches:
            for text in batch.column(0):
                for words in words_of(text.as_py()):
                    seen.update(words)
                    if len(seen) > _FLUSH:
                        yield flush()
                        seen.clear()
        yield flush()

    src = docs.select(F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    return src.mapInArrow(run, "word binary, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What a task needs to read texts: bounded in size."""

    words: list[bytes]  # known words, the first ``own`` of them symbols of their own
    counts: np.ndarray
    own: int
    tokens: int  # N: training tokens, ends included
    distinct: int  # V
    texts: int  # training texts, the count of the end
    held: np.ndarray  # tokens of each ending's words
    kinds: np.ndarray  # distinct words of each ending

    @property
    def symbols(self) -> int:
        return self.own + ENDINGS + 1

    def symbol_counts(self) -> np.ndarray:
        return np.concatenate([self.counts[:self.own], self.held, [self.texts]]).astype(float)

    def base_total(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))

    def ending_totals(self) -> np.ndarray:
        return np.log10(self.held + 0.5 * (self.kinds + 1))


def vocabulary(counts: DataFrame, n_texts: int) -> tuple[Vocabulary, int]:
    """The vocabulary of a ``word_counts`` table, and the count from which a short word is known.

    Words are ranked by a logarithmic step of their count, whole steps at a
    time, so no task sorts them; where a step is too wide its words are not held.
    """
    step = F.floor(F.log2("n") * 32)
    short = F.octet_length("word") <= KNOWN_BYTES
    hist = counts.groupBy(step.alias("step")).agg(F.count("*").alias("kinds"), F.sum("n").alias("tokens"), F.count_if(short).alias("short"),
                                                  F.min("n").alias("low")).toPandas().sort_values("step", ascending=False)
    total = hist["short"].cumsum()
    least = lambda limit: int(hist["low"][total <= limit].min()) if (total <= limit).any() else 2 ** 62
    known, own = least(KNOWN), least(OWN_WORDS)
    table = counts.where(short & (F.col("n") >= known)).select("word", "n").toArrow()  # KNOWN rows at most
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    classes = counts.where(~short | (F.col("n") < own)).groupBy("ending").agg(F.count("*").alias("k"), F.sum("n").alias("n")).toArrow()
    held, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    held[classes.column("ending").to_numpy()] = classes.column("n").to_numpy()
    kinds[classes.column("ending").to_numpy()] = classes.column("k").to_numpy()
    return Vocabulary([words[i] for i in order], np.asarray(n)[order], int((np.asarray(n) >= own).sum()),
                      int(hist["tokens"].sum()) + n_texts, int(hist["kinds"].sum()) + (n_texts > 0), n_texts, held, kinds), known


class _Lookup(dict):
    """Word -> code; an unknown word is noted and gets its ending's code."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.first, self.rare = len(words), []

    def __missing__(self, word: bytes) -> int:
        self.rare.append(word)
        return self.first + zlib.crc32(word[-_TAIL:]) % ENDINGS


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Columns of ``docs`` (text last) without text, plus its tokens as symbols and its sums over the known words.

    ``base`` and ``inner`` (log10) lack log10(count + 0.5) of the words in ``rare``, which no task knows.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocab)
    passed = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        look = _Lookup(v.words)
        n = len(v.words)
        ends = np.array([ending(w) for w in v.words[v.own:]], np.int64)
        own = np.concatenate([np.ones(v.own, bool), np.zeros(n - v.own + ENDINGS, bool), [True]])
        symbol = np.concatenate([np.arange(v.own), v.own + ends, v.own + np.arange(ENDINGS), [v.own + ENDINGS]]).astype(np.int16)
        count = np.concatenate([np.log10(v.counts + 0.5), np.zeros(ENDINGS), [np.log10(v.texts + 0.5)]])
        base = count - v.base_total()
        inner = np.where(own, 0, count - np.concatenate([v.ending_totals(), [0]])[np.clip(symbol.astype(int) - v.own, 0, ENDINGS)])
        known = np.concatenate([np.ones(n, np.int64), np.zeros(ENDINGS, np.int64), [int(v.texts > 0)]])
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out: dict = {c: [] for c in ("n", "known", "base", "inner")}
                symbols, rare, rare_n = [], [], []
                for text in part.column(part.num_columns - 1):
                    codes, look.rare = [], []
                    for words in words_of(text.as_py()):
                        codes.append(np.fromiter(map(look.__getitem__, words), np.int64, len(words)))
                    codes.append(np.array([n + ENDINGS]))
                    codes = np.concatenate(codes)
                    symbols.append(symbol[codes])
                    for name, value in (("n", len(codes)), ("known", known[codes].sum()), ("base", base[codes].sum()), ("inner", inner[codes].sum())):
                        out[name].append(value)
                    some = Counter(look.rare)
                    rare.append(list(some))
                    rare_n.append(list(some.values()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(out["n"], pa.int64()), pa.array(out["known"], pa.int64()), pa.array(out["base"], pa.float64()),
                     pa.array(out["inner"], pa.float64()), pa.array(symbols, pa.list_(pa.int16())), pa.array(rare, pa.list_(pa.binary())),
                     pa.array(rare_n, pa.list_(pa.int32()))],
                    names=[*passed, "n_tokens", "n_known", "base", "inner", "symbols", "rare", "rare_n"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(
        run, f"{schema}, n_tokens long, n_known long, base double, inner double, symbols array<short>, rare array<binary>, rare_n array<int>")


@dataclass
class Model:
    """start: K; step: K x K; emit: symbols x K."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


class _Slice:
    """Sequences flat[offsets[i]:offsets[i + 1]], cut into segments that run side by side, longest first.

    Everything is kept step by step: ``at[t]`` is where step t's rows begin, one row per segment that is still running.
    """

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, m: Model, segment: int):
        sizes = np.diff(offsets)
        self.parts = -(-sizes // segment)
        text = np.repeat(np.arange(len(sizes)), self.parts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(self.parts) - self.parts, self.parts)
        begin = offsets[:-1][text] + number * segment
        length = np.minimum(segment, offsets[1:][text] - begin)
        order = np.argsort(-length, kind="stable")
        self.m, self.text, self.number, self.length = m, text[order], number[order], length[order]
        self.running = np.searchsorted(-self.length, -np.arange(1, int(length.max(initial=0)) + 1), "right")
        self.at = np.concatenate([[0], np.cumsum(self.running)])
        step = np.repeat(np.arange(len(self.running)), self.running)
        row = np.arange(self.at[-1]) - self.at[step]
        self.symbols = flat[begin[order][row] + step]
        self.emit = np.take(m.emit, self.symbols, axis=0)
        self.ones = np.ones(len(m.start))
        self.entry = np.tile(m.start, (len(order), 1))
        self.before, self.behind = np.zeros_like(self.entry), np.ones_like(self.entry)
        if (self.parts > 1).any():
            self._cuts()

    def _cuts(self):
        """Exact state vectors at the cuts: ``entry`` before a segment's first symbol, ``before`` it by one step, ``behind`` its last."""
        k, m = len(self.ones), self.m
        rows = np.flatnonzero(self.parts[self.text] > 1)
        product = np.empty((len(rows), k, k))
        for t, running in enumerate(self.running):
            n = int(np.searchsorted(rows, running))
            if not n:
                break
            emit = self.emit[self.at[t] + rows[:n]][:, None, :]
            product[:n] = (np.eye(k) if t == 0 else (product[:n].reshape(-1, k) @ m.step).reshape(n, k, k)) * emit
            if t % 8 == 7:
                product[:n] /= product[:n].sum(axis=(1, 2), keepdims=True)
        by_text = np.lexsort((self.number[rows], self.text[rows]))
        last = -1
        for i in by_text:
            r = rows[i]
            if self.number[r]:  # the row before is the segment before
                a = self.entry[rows[last]] @ product[last]
                self.before[r] = a / a.sum()
                self.entry[r] = self.before[r] @ m.step
            last = i
        last = -1
        for i in by_text[::-1]:
            r = rows[i]
            if last >= 0 and self.text[rows[last]] == self.text[r]:
                b = m.step @ (product[last] @ self.behind[rows[last]])
                self.behind[r] = b / b.sum()
            last = i

    def forward(self) -> np.ndarray:
        """Natural log of each text's likelihood; leaves the scaled state vectors in ``alpha``, their scales in ``scale``."""
        a, step = self.entry.copy(), self.m.step
        self.alpha, self.scale = np.empty_like(self.emit), np.empty(len(self.emit))
        for i, j in zip(self.at[:-1], self.at[1:]):
            now = np.multiply(a[:j - i], self.emit[i:j], out=self.alpha[i:j])
            scale = np.matmul(now, self.ones, out=self.scale[i:j])
            now /= scale[:, None]
            np.matmul(now, step, out=a[:j - i])
        row = np.arange(self.at[-1]) - np.repeat(self.at[:-1], self.running)
        return np.bincount(self.text[row], weights=np.log(self.scale), minlength=len(self.parts))

    def backward(self) -> tuple[np.ndarray, np.ndarray]:
        """Expected starts and steps; turns ``alpha`` into the states' shares of every symbol."""
        m, b = self.m, self.behind
        steps, later = np.zeros_like(m.step), 0
        for t in range(len(self.running) - 1, -1, -1):
            i, j = self.at[t], self.at[t + 1]
            if later:
                z = self.emit[j:j + later] * b[:later]
                z /= self.scale[j:j + later, None]
                steps += self.alpha[i:i + later].T @ z
                np.matmul(z, m.step.T, out=b[:later])
            now = self.alpha[i:j]
            if later < j - i:  # segments that end here: the weight behind them is scaled to them
                b[later:j - i] /= (now[later:] * b[later:j - i]).sum(axis=1, keepdims=True)
            now *= b[:j - i]
            later = j - i
        first = self.number == 0
        z = self.emit[:later][~first[:later]] * b[:later][~first[:later]] / self.scale[:later][~first[:later], None]
        steps += self.before[:later][~first[:later]].T @ z
        return self.alpha[:later][first[:later]].sum(axis=0), steps * m.step


def log_likelihoods(flat: np.ndarray, offsets: np.ndarray, m: Model, segment: int = SEGMENT) -> np.ndarray:
    """Natural log of the likelihood of every sequence flat[offsets[i]:offsets[i + 1]]."""
    return _Slice(flat, offsets, m, segment).forward()


def expected_counts(flat: np.ndarray, offsets: np.ndarray, m: Model, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts (K), steps (K x K), emissions (symbols x K) over the sequences, and their log likelihood."""
    s = _Slice(flat, offsets, m, segment)
    log = float(s.forward().sum())
    starts, steps = s.backward()
    emissions = np.stack([np.bincount(s.symbols, weights=s.alpha[:, i], minlength=len(m.emit)) for i in range(len(m.start))], axis=1)
    return starts, steps, emissions, log


def _sequences(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of a symbols column of about ``_SLICE`` symbols: (first row, last row + 1, flat, offsets)."""
    ends = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy()
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + _SLICE, "right")) - 1)
        yield i, j, flat[ends[i]:ends[j]].astype(np.int64), ends[i:j + 1] - ends[i]
        i = j


def first_model(weights: np.ndarray, states: int, seed: int = _SEED) -> Model:
    """Every state starts from the corpus's symbol distribution, blurred differently; states tend to stay."""
    noise = np.exp(np.random.default_rng(seed).normal(0, 0.7, (len(weights), states)))
    emit = weights[:, None] * noise
    step = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(axis=0))


def train(encoded: DataFrame, weights: np.ndarray, states: int = STATES, iterations: int = ITERATIONS) -> tuple[Model, list[float]]:
    """Baum-Welch over all rows of ``encoded`` (column symbols); the model and the log likelihood before each iteration.

    ``weights`` is the smoothed symbol distribution of the corpus: the start and the prior of every state.
    """
    spark = encoded.sparkSession
    model, history = first_model(weights, states), []
    columns = [f"w{i}" for i in range(states)]
    for _ in range(iterations):
        held = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            m = held.value
            k = len(m.start)
            total = np.zeros((len(m.emit) + k + 2, k))  # emissions, steps, starts, log likelihood
            for batch in batches:
                for _, _, flat, offsets in _sequences(batch.column(0)):
                    starts, steps, emissions, log = expected_counts(flat, offsets, m)
                    total[:-k - 2] += emissions
                    total[-k - 2:-2] += steps
                    total[-2] += starts
                    total[-1, 0] += log
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(total[at, i].astype(np.float32)) for i in range(k))],
                                             names=["at", *columns])

        parts = encoded.select("symbols").mapInArrow(run, "at int, " + ", ".join(f"{c} float" for c in columns))
        got = parts.groupBy("at").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()  # a row per symbol at most
        total = np.zeros((len(weights) + states + 2, states))
        total[got.column("at").to_numpy()] = np.stack([got.column(c).to_numpy() for c in columns], axis=1)
        emit = total[:-states - 2] + PRIOR * weights[:, None]
        step = total[-states - 2:-2] + PRIOR_STEPS
        start = total[-2] + PRIOR_STEPS
        model = Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        history.append(float(total[-1, 0]))
        held.unpersist()
    return model, history


def score(docs: DataFrame, scratch: Scratch, learn: Column, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """Per row of ``docs``: its columns but text, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows for which ``learn`` holds and scores all rows: ``score`` is
    the model's log10 probability of the text, ``base_score`` that of smoothed
    word counts.  A null or empty text is the end alone.  Repeated rows are scored
    each, and learnt from as often as they occur.  Without rows to learn from all
    words are unknown and the states alike.  Columns named like a result are
    replaced; an empty table gives no rows.
    """
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in docs.columns if c not in ("text", *made)]
    src = docs.withColumn("_learn", F.coalesce(learn, F.lit(False)))
    counts = scratch.table(word_counts(src.where("_learn")), "counts")
    vocab, known = vocabulary(counts, src.where("_learn").count())
    rows = src.select(F.struct(*kept).alias("_row"), "_learn", F.monotonically_increasing_id().alias("_id"), "text")
    encoded = scratch.table(encode(rows, vocab), "encoded")  # the running ids are fixed from here on
    weights = vocab.symbol_counts() + 0.5
    model, _ = train(encoded.where("_learn"), weights / weights.sum(), states, iterations)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            logs = [log_likelihoods(flat, offsets, m) for _, _, flat, offsets in _sequences(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.empty(0), *logs]) / np.log(10))], names=["_id", "log"])

    # words that no task knows: their counts come by a join, added up per text
    rare = encoded.select("_id", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select("_id", "w.rare", "w.rare_n")
    others = counts.where((F.octet_length("word") > KNOWN_BYTES) | (F.col("n") < known)).select("word", "n")
    sums = (rare.join(others, F.col("rare") == F.col("word"), "left").groupBy("_id").agg(
        F.sum(F.col("rare_n") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("rare_n")).otherwise(0)).alias("rare_known")))
    logs = encoded.select("_id", "symbols").mapInArrow(run, "_id long, log double")
    logs = scratch.table(logs, "logs")
    out = (encoded.select("_row", "_id", "n_tokens", "n_known", "base", "inner").join(logs, "_id")
           .join(scratch.table(sums, "rare"), "_id", "left").na.fill(0, ["rare_log", "rare_known"]))
    return out.select("_row.*", "n_tokens", (F.col("n_known") + F.col("rare_known")).alias("n_known"),
                      F.lit(vocab.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.col("rare_log")).alias("base_score"),
                      (F.col("log") + F.col("inner") + F.col("rare_log")).alias("score"))
