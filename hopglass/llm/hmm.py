"""Operator 7: a hidden Markov language model.

A text is its words (A-Z lower-cased) and one end token.  Each token belongs to one of CLASSES classes by the hash of its
word (the end token to a class of its own).  The model has STATES latent states: start and transition probabilities, and
P(token | state) = P(class | state) P(token | class), where P(token | class) = (count + 1) / (class count + class words + 1)
keeps one share for words never seen.  So what Baum-Welch has to estimate has a fixed size, while the word counts behind
it are exact, grow with the corpus and stay in a table.

Training: word counts over all training texts; start values from how often each class is followed by each of FOLLOWERS
groups of classes, counted over every training token (a table of fixed size, whose latent factors are fitted by expectation
maximization); then ``rounds`` Baum-Welch iterations over every training token.  Each task adds up (expected) counts, which
are summed by class, or state and class, across partitions.  Training cuts long texts into windows of WINDOW tokens (every token is used; only the
transition between two windows isn't counted), so texts advance in step.  Scoring runs the scaled forward recursion over
whole texts; the likelihood is exact.  Counts of the most frequent ``known_words`` words go to the tasks as one table of
bounded size; the other words of a text are joined with the table of counts.

A null text is an empty one: just the end token.  Ids of held-out rows are by crc32; a null id is not held out.  Repeated
rows count and are scored each.  Empty training gives the smoothed uniform; an empty table gives no rows."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopglass.session import cut

from .common import id_and_text, lower_words_of, steps
from .text_stats import Numbers

STATES, CLASSES, WINDOW = 8, 8192, 256
#: Groups of classes that the start values tell apart in what follows a token.
FOLLOWERS = 96
END = CLASSES
#: Stands for the end token in tables of words; no word holds a space.
END_WORD = " "


class _Classes(Numbers):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = zlib.crc32(word) & CLASSES - 1
        return n


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


class Model:
    """start (S), move (S, S), emit (S, CLASSES + 1)."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        emit = rng.dirichlet(np.full(CLASSES + 1, 2.0), STATES)
        move = 0.5 * np.eye(STATES) + 0.5 / STATES
        return cls(np.full(STATES, 1 / STATES), move, emit)

    @classmethod
    def of(cls, counts: np.ndarray) -> Model:
        """From expected counts, laid out as in ``expected``; a little is added everywhere."""
        start, move, emit = counts[0, :STATES] + 0.1, counts[1 : STATES + 1, :STATES] + 0.1, counts[STATES + 1 :].T + 0.01
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def in_step(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, longest first, laid out by time: the order, how many go on at each time, and the tokens."""
    n = np.fromiter(map(len, sequences), np.int64, len(sequences))
    order = np.argsort(-n, kind="stable")
    n = n[order]
    alive = np.searchsorted(-n, -np.arange(n[0]), side="left") if len(n) else np.zeros(0, np.int64)
    begin = np.cumsum(alive) - alive
    flat = np.concatenate([sequences[i] for i in order])
    time = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    tokens = np.empty(len(flat), np.int64)
    tokens[begin[time] + np.repeat(np.arange(len(n)), n)] = flat
    return order, alive, tokens


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each sequence by the scaled forward recursion."""
    if not sequences:
        return np.zeros(0)
    order, alive, tokens = in_step(sequences)
    emit, total, at = np.ascontiguousarray(model.emit.T), np.zeros(len(sequences)), 0
    alpha = np.broadcast_to(model.start, (len(sequences), STATES))
    for t, k in enumerate(alive.tolist()):
        alpha = alpha[:k] @ model.move if t else alpha
        alpha = alpha * emit[tokens[at : at + k]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        total[:k] += np.log10(scale)
        at += k
    out = np.empty(len(sequences))
    out[order] = total
    return out


def expected(model: Model, sequences: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Expected counts of one Baum-Welch step: row 0 starts, then transitions, then states by class.  starts: which
    sequences begin a text."""
    counts = np.zeros((1 + STATES + CLASSES + 1, STATES))
    if not sequences:
        return counts
    order, alive, tokens = in_step(sequences)
    emit, move = np.ascontiguousarray(model.emit.T), model.move
    begin = (np.cumsum(alive) - alive).tolist()
    alphas, scales = np.empty((len(tokens), STATES)), np.empty(len(tokens))
    alpha = np.broadcast_to(model.start, (len(sequences), STATES))
    for t, (k, a) in enumerate(zip(alive.tolist(), begin, strict=True)):
        alpha = (alpha[:k] @ move if t else alpha) * emit[tokens[a : a + k]]
        scales[a : a + k] = scale = alpha.sum(1)
        alphas[a : a + k] = alpha = alpha / scale[:, None]
    beta = np.ones((0, STATES))
    later = None
    for t in range(len(alive) - 1, -1, -1):
        k, a = int(alive[t]), begin[t]
        full = np.ones((k, STATES))
        if later is not None:
            ahead = later  # emission times beta over scale, of those that go on
            full[: len(ahead)] = ahead @ move.T
            counts[1 : STATES + 1] += move * (alphas[a : a + len(ahead)].T @ ahead)
        beta = full
        later = emit[tokens[a : a + k]] * beta / scales[a : a + k, None]
        alphas[a : a + k] *= beta
        if t == 0:
            counts[0] = alphas[:k][starts[order]].sum(0)
    for s in range(STATES):
        counts[1 + STATES :, s] = np.bincount(tokens, alphas[:, s], CLASSES + 1)
    return counts


def class_ids(texts: list[str], classes: _Classes) -> list[np.ndarray]:
    if len(classes) > 500_000:
        classes.clear()
    out = []
    for text in texts:
        words = lower_words_of(text)
        ids = np.empty(len(words) + 1, np.int64)
        ids[:-1], ids[-1] = np.fromiter(map(classes.__getitem__, words), np.int64, len(words)), END
        out.append(ids)
    return out


def windows(sequences: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [s[k : k + WINDOW] for s in sequences for k in range(0, len(s), WINDOW)]
    return parts, np.array([k == 0 for s in sequences for k in range(0, len(s), WINDOW)], bool)


def word_counts(texts: DataFrame) -> DataFrame:
    """word, count over all tokens, end tokens included: counted inside each batch, then summed."""

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for _, some in steps([batch]):
                for text in some:
                    seen.update(lower_words_of(text))
                seen[END_WORD.encode()] += len(some)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """word and n of the words over a count that at most ``most`` words reach, found from a histogram of sixteenths of powers of
    two (a thousand rows or so), without sorting the words."""
    step = F.floor(F.log2("n") * 16).cast("int")
    bound, total = 1 << 20, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True):
        total += r["words"]
        if total > most:
            break
        bound = r["step"]
    return counts.filter(step >= bound).select("word", "n")


def word_class(word) -> F.Column:
    return F.when(word == END_WORD, F.lit(END)).otherwise(F.crc32(word.cast("binary")).bitwiseAND(F.lit(CLASSES - 1)).cast("int"))


def baum_welch(texts: DataFrame, model: Model) -> Model:
    """One iteration over all texts."""

    def run(batches):
        classes, total = _Classes(), np.zeros((1 + STATES + CLASSES + 1, STATES))
        for _, some in steps(batches):
            total += expected(model, *windows(class_ids(some, classes)))
        place = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), *(pa.array(total[place, s]) for s in range(STATES))], ["place", *(f"s{s}" for s in range(STATES))])

    parts = texts.mapInArrow(run, "place int, " + ", ".join(f"s{s} double" for s in range(STATES)))
    summed = parts.groupBy("place").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(STATES))).toPandas()  # at most one row per start, state and class
    counts = np.zeros((1 + STATES + CLASSES + 1, STATES))
    counts[summed["place"]] = summed[[f"s{s}" for s in range(STATES)]]
    return Model.of(counts)


def follower_counts(texts: DataFrame) -> np.ndarray:
    """How often a token of each class (row) is followed by one of each group of classes (column), over all texts; the end
    token is followed by the first one of its text."""

    def run(batches):
        classes, total = _Classes(), np.zeros((CLASSES + 1) * FOLLOWERS, np.int64)
        for _, some in steps(batches):
            ids = class_ids(some, classes)
            if ids:
                after = np.concatenate([np.roll(i, -1) for i in ids]) % FOLLOWERS
                total += np.bincount(np.concatenate(ids) * FOLLOWERS + after, minlength=len(total))
        total = total.reshape(-1, FOLLOWERS)
        place = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), *(pa.array(total[place, f]) for f in range(FOLLOWERS))], ["place", *(f"f{f}" for f in range(FOLLOWERS))])

    parts = texts.mapInArrow(run, "place int, " + ", ".join(f"f{f} long" for f in range(FOLLOWERS)))
    summed = parts.groupBy("place").agg(*(F.sum(f"f{f}").alias(f"f{f}") for f in range(FOLLOWERS))).toPandas()  # CLASSES + 1 rows at most
    counts = np.zeros((CLASSES + 1, FOLLOWERS))
    counts[summed["place"]] = summed[[f"f{f}" for f in range(FOLLOWERS)]]
    return counts


def start_values(counts: np.ndarray, rounds: int = 100, seed: int = 5) -> Model:
    """The model whose states are the latent factors of the counts: P(class, group after it) = sum over states of
    P(state) P(class | state) P(group after it | state)."""
    if not counts.any():
        return Model.first()
    rng = np.random.default_rng(seed)
    own, after = rng.dirichlet(np.full(CLASSES + 1, 2.0), STATES).T / STATES, rng.dirichlet(np.full(FOLLOWERS, 2.0), STATES)
    for _ in range(rounds):
        ratio = counts / np.maximum(own @ after, 1e-300)
        own, after = own * (ratio @ after.T), after * (own.T @ ratio) + 0.01
        own, after = own / own.sum(), after / after.sum(1, keepdims=True)
    share = own.sum(0)
    emit = own.T * counts.sum() + 0.01
    emit /= emit.sum(1, keepdims=True)
    group = np.array([np.bincount(np.arange(CLASSES + 1) % FOLLOWERS, e, FOLLOWERS) for e in emit])
    move = np.full((STATES, STATES), 1 / STATES)
    for _ in range(50):  # after = move @ group
        move *= (after / (move @ group)) @ group.T
        move /= move.sum(1, keepdims=True)
    move += 0.001
    return Model((share + 0.001) / (share + 0.001).sum(), move / move.sum(1, keepdims=True), emit)


def trained(texts: DataFrame, rounds: int = 2) -> Model:
    model = start_values(follower_counts(texts))
    for _ in range(rounds):
        model = baum_welch(texts, model)
    return model


def scores(docs: DataFrame, rounds: int = 2, known_words: int = 1 << 17) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts = id_and_text(docs)
    training = texts.filter(~held_out(F.col("doc_id")))
    counts = cut(word_counts(training).withColumn("class", word_class(F.col("word"))))
    by_class = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toPandas()  # CLASSES + 1 rows at most
    size, distinct = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    size[by_class["class"]], distinct[by_class["class"]] = by_class["n"], by_class["words"]
    n, v = int(size.sum()), int(distinct.sum())
    spread = np.log10(size + distinct + 1)
    model = trained(training, rounds)
    frequent = most_frequent(counts, known_words).toArrow()
    table = dict(zip(frequent.column("word").cast(pa.binary()).to_pylist(), np.log10(frequent.column("n").to_numpy() + 1).tolist(), strict=True))

    def run(batches):
        classes, end = _Classes(), float(np.log10(size[END] + 1))
        for keys, some in steps(batches):
            words, ids = [lower_words_of(t) for t in some], class_ids(some, classes)
            found = [np.array(list(map(table.get, w)), float) for w in words]  # None becomes NaN
            tops = np.array([np.nansum(f) for f in found]) + end
            known = [int((~np.isnan(f)).sum()) for f in found]
            rare = [b" ".join([x for x, miss in zip(w, np.isnan(f).tolist(), strict=True) if miss]) for w, f in zip(words, found, strict=True)]
            chain = forward(model, ids) - np.array([spread[i].sum() for i in ids])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array(known, pa.int64()), pa.array(tops), pa.array(chain), pa.array(rare, pa.binary()).cast(pa.string())],
                                             ["doc_id", "n_tokens", "known", "tops", "chain", "rare"])

    rows = texts.mapInArrow(run, "doc_id long, n_tokens long, known long, tops double, chain double, rare string")
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    rest = rows.filter("rare <> ''").select("_row", F.explode(F.split("rare", " ")).alias("word"))
    rest = rest.join(counts.select("word", "n"), "word").groupBy("_row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count("*").alias("found"))
    total = F.col("tops") + F.coalesce("more", F.lit(0.0))  # log10(count + 1) over all tokens
    ends = 1 if n else 0
    return rows.join(rest, "_row", "left").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0)) + ends).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                                                 (total - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), (F.col("chain") + total).alias("score"))
