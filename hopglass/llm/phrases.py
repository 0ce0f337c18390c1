"""Operator 11: phrase collocations by mergeable Misra-Gries summaries.

Everything is per language.  Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words
``[^\\x20\\x09]+``; n-grams of 1 to MAX_WORDS words inside a piece are counted.

First pass: n-grams as 64-bit hashes are dealt to hash partitions.  Each partition holds one Misra-Gries summary with more
counters than (mass of the partition) / threshold; a task sends its exact mass ahead of its counts, so the capacity is known before the first
counter is lowered.  All that was ever taken from a counter, D, is then below the threshold, so every frequent n-gram keeps a
counter; those whose counter + D stays below the threshold are let go, which is exact as well.  Words and pairs go first; longer n-grams follow, of
which every pair of neighbours has survived.  The survivors are marked in a bitmap of fixed size (FILTER_BITS, whatever the
data), which only ever lets too many through.

Second pass: n-grams that the bitmap lets through are counted exactly, by their words, and joined to their parts.  Tasks
count in steps of STEP_WORDS words before anything is shuffled, so a popular n-gram is one row per step.

Null texts are empty, a null language is ``und``; rows without words add nothing.  Repeated rows count each.  Ties of the score go to the
larger count, then to the smaller phrase in byte order.  Further columns are left behind.  An empty table gives no rows."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopglass.operators.skew import hot_keys, join_on_hot_key

from .common import table_cut
from .near import mixed

MAX_WORDS, THRESHOLD, TOP = 4, 30, 2000
#: Bits of the survivors' bitmap, 4 MB: a constant, more bits let fewer n-grams through in vain.
FILTER_BITS = 1 << 25
#: Words counted at a time inside a task; a longer text is a step of its own.
STEP_WORDS, STEP_VOCABULARY = 1 << 18, 1 << 17
#: Bytes of text behind one task of the summaries and behind one hash partition; a task goes through its partitions one after the other.
PARTITION_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 64 << 20, 8 << 20, 64
#: Every byte to itself, A-Z to a-z, the ends of pieces to a line feed, tabs to spaces.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
EMPTY, END = 0, 1
_FACTORS = np.random.default_rng(20_260_311).integers(0, 1 << 64, MAX_WORDS + 1, np.uint64) | np.uint64(1)


def hash_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Vocabulary(dict):
    """Numbers of words, in the order they are first met; 0 is no word, 1 the end of a piece."""

    def __init__(self):
        self.start()

    def start(self):
        self.clear()
        self.names, self.hashes = [b"", b"\n"], array("Q", [0, 0])
        self.update({b"": EMPTY, b"\n": END})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        self.hashes.append(hash_of(word))
        return n


class Step:
    """Some texts as one row of word numbers with an end after each piece, and the language of each place."""

    def __init__(self, vocabulary: Vocabulary, parts: list[np.ndarray], langs: list[str]):
        self.vocabulary, self.names = vocabulary, sorted(set(langs))
        number = {name: i for i, name in enumerate(self.names)}
        self.ids = np.concatenate(parts)
        self.lang = np.repeat(np.array([number[x] for x in langs], np.int32), [len(p) for p in parts])
        self.hashes = np.array(vocabulary.hashes, np.uint64)[self.ids]
        self.found: dict[int, np.ndarray] = {}
        self.inside = {1: self.ids != END}
        for n in range(2, MAX_WORDS + 1):
            self.inside[n] = self.inside[n - 1][:-1] & self.inside[1][n - 1 :] if len(self.ids) >= n else np.zeros(0, bool)

    def keys(self, n: int) -> np.ndarray:
        """64-bit keys of the n-gram, with its language, at every place where n words fit."""
        if n not in self.found:
            size = max(len(self.ids) - n + 1, 0)
            with np.errstate(over="ignore"):
                own = np.array([hash_of(x.encode()) for x in self.names], np.uint64)[self.lang[:size]] + np.uint64(n)
                for k in range(n):
                    own += mixed(self.hashes[k : k + size] + _FACTORS[k]) * _FACTORS[k]
                self.found[n] = mixed(own)
        return self.found[n]


def step_texts(batches: Iterable[pa.RecordBatch], step_words: int = STEP_WORDS) -> Iterator[Step]:
    """Steps over Arrow batches of (lang, text)."""
    vocabulary, parts, langs, held = Vocabulary(), [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tokens = text.as_py().encode().translate(FOLD).replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(vocabulary.__getitem__, tokens), np.int64, len(tokens))
            parts.append(np.append(ids[ids != EMPTY], END))
            langs.append(lang)
            held += len(parts[-1])
            if held >= step_words:
                yield Step(vocabulary, parts, langs)
                parts, langs, held = [], [], 0
                if len(vocabulary) > STEP_VOCABULARY:
                    vocabulary.start()
    if parts:
        yield Step(vocabulary, parts, langs)


def let_through(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the bitmap (64-bit words) holds."""
    bit = keys & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def grown(step: Step, bitmap: np.ndarray | None) -> dict[int, np.ndarray]:
    """Places where an n-gram can be frequent, by n: inside a piece, and all its pairs of neighbours in the bitmap."""
    if bitmap is None:
        return step.inside
    pairs = step.inside[2] & let_through(bitmap, step.keys(2))
    return {1: step.inside[1], 2: pairs, 3: pairs[:-1] & pairs[1:], 4: pairs[:-2] & pairs[1:-1] & pairs[2:]}


def partial_counts(texts: DataFrame, sizes: tuple[int, ...], buckets: int, bitmap=None, step_words: int = STEP_WORDS) -> DataFrame:
    """Counts of n-grams by step, packed by bucket (hash partition): bucket, mass (null), keys, counts; ahead of them the mass of a task by
    bucket (keys and counts null)."""
    names = ["bucket", "mass", "keys", "counts"]

    def packed(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bitmap is None else np.frombuffer(bitmap.value, np.uint64)
        mass = np.zeros(buckets, np.int64)
        for step in step_texts(batches, step_words):
            places = grown(step, known)
            key, n = np.unique(np.concatenate([step.keys(size)[places[size]] for size in sizes]), return_counts=True)
            bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            mass += np.bincount(bucket, n, buckets).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, n, bucket = key[order], n[order], bucket[order]
            if len(key):
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                edges = np.append(first, len(key)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), pa.nulls(len(first), pa.int64()), packed(key.view(np.int64), edges, pa.int64()), packed(n.astype(np.int32), edges, pa.int32())], names)
        used = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32), pa.int32()), pa.array(mass[used], pa.int64()), pa.nulls(len(used), pa.list_(pa.int64())), pa.nulls(len(used), pa.list_(pa.int32()))], names)

    return texts.mapInArrow(run, "bucket int, mass long, keys array<long>, counts array<int>")


class Summary:
    """Misra-Gries summary of one hash partition: at most ``capacity`` counters, ``taken`` from each at most."""

    def __init__(self):
        self.mass = self.taken = self.waiting = 0
        self.keys, self.counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def capacity(self, threshold: int) -> int:
        return self.mass // threshold + 1

    def add(self, keys: np.ndarray, counts: np.ndarray, threshold: int) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > max(self.capacity(threshold), 1 << 16):
            self.merge(threshold)

    def merge(self, threshold: int) -> None:
        """Add up what waits; if too many counters remain, lower all by the largest one that has to go."""
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        over = len(keys) - self.capacity(threshold)
        if over > 0:
            low = int(np.partition(counts, over - 1)[over - 1])
            self.taken += low
            keys, counts = keys[counts > low], counts[counts > low] - low
        self.keys, self.counts, self.waiting = [keys], [counts], 0

    def survivors(self, threshold: int) -> np.ndarray:
        self.merge(threshold)
        return self.keys[0][self.counts[0] + self.taken >= threshold]


def survivors(counts: DataFrame, partitions: int, threshold: int) -> DataFrame:
    """key: every n-gram that occurs ``threshold`` times or more, and few others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(summary):
            return pa.RecordBatch.from_arrays([pa.array(summary.survivors(threshold), pa.int64())], ["key"])

        at, summary = None, Summary()
        for batch in batches:
            bucket, mass = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, own in enumerate(bucket):
                if own != at:
                    if at is not None:
                        yield done(summary)
                    at, summary = own, Summary()
                if mass[i] is not None:
                    summary.mass += mass[i]
                else:
                    summary.add(*(batch.column(k)[i].values.to_numpy().astype(np.int64) for k in (2, 3)), threshold)
        if at is not None:
            yield done(summary)

    # the masses of a bucket come before its counts
    return counts.repartition(partitions, "bucket").sortWithinPartitions("bucket", F.col("mass").isNull()).mapInArrow(run, "key long")


def bitmap_of(keys: DataFrame, bits: int) -> np.ndarray:
    """The keys' bitmap, put together by 64-bit words; what reaches the driver is at most the bitmap."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.sort(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(bits - 1))
            word = (bit >> np.uint64(6)).astype(np.int64)
            if len(word):
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                both = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int32)), pa.array(both.view(np.int64))], ["word", "bits"])

    found = keys.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return out


def numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each different pair."""
    return np.unique(a << 32 | b, return_inverse=True)[1]


def exact_counts(texts: DataFrame, bitmap, step_words: int = STEP_WORDS) -> DataFrame:
    """lang, words, phrase, n by step of the n-grams that the bitmap lets through; all words of the step under words = 0."""

    def counted(ids: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A place and the count of each different n-gram at the given places, told apart by its words."""
        if n == 1:
            own = ids[at]
        elif n < 4:
            own = numbered(ids[at], ids[at + 1]) if n == 2 else numbered(numbered(ids[at], ids[at + 1]), ids[at + 2])
        else:
            own = numbered(numbered(ids[at], ids[at + 1]), numbered(ids[at + 2], ids[at + 3]))
        _, first, count = np.unique(own, return_index=True, return_counts=True)
        return at[first], count

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bitmap.value, np.uint64)
        for step in step_texts(batches, step_words):
            places, names, ids = grown(step, known), step.vocabulary.names, step.ids
            open_ = {n: places[n] & let_through(known, step.keys(n)) for n in places}
            for i, lang in enumerate(step.names):
                phrases, words, counts = [""], [0], [int((step.inside[1] & (step.lang == i)).sum())]
                for n, hit in open_.items():
                    at, count = counted(ids, np.flatnonzero(hit & (step.lang[: len(hit)] == i)), n)
                    phrases += [b" ".join([names[w] for w in ids[p : p + n]]).decode() for p in at.tolist()]
                    words += [n] * len(at)
                    counts += count.tolist()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.int32()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64())], ["lang", "words", "phrase", "n"])

    return texts.mapInArrow(run, "lang string, words int, phrase string, n long")


def frequent(docs: DataFrame, threshold: int = THRESHOLD, filter_bits: int = FILTER_BITS, step_words: int = STEP_WORDS) -> DataFrame:
    """lang, words, phrase, n: exact counts of all n-grams of 1 to MAX_WORDS words with n >= threshold; all words under words = 0."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text is not null and text <> ''")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES + 1)
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES + 1)  # follows the data, not the session
    short = bitmap_of(survivors(partial_counts(texts, (1, 2), buckets, None, step_words), partitions, threshold), filter_bits)
    held = spark.sparkContext.broadcast(short.tobytes())
    long = bitmap_of(survivors(partial_counts(texts, (3, 4), buckets, held, step_words), partitions, threshold), filter_bits)
    exact = exact_counts(texts, spark.sparkContext.broadcast((short | long).tobytes()), step_words)
    return exact.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= threshold) | (F.col("words") == 0))


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int | None = TOP, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases (None: all) of each language."""
    counts = table_cut(frequent(docs, threshold, **how))
    grams = counts.filter("words > 0")
    found = grams.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))

    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    for part, count in (("first", "l"), ("rest", "r")):
        one = grams.select("lang", F.col("phrase").alias(part), F.col("n").alias(count))
        cuts = join_on_hot_key(cuts, one, ["lang", part], hot_keys(cuts, ["lang", part]))
    score = F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = found.filter("words > 2").select("lang", "phrase", "words", F.col("a").alias("around"), F.explode(F.expr("sequence(2, words - 1)")).alias("size"))
    inner = inner.withColumn("start", F.explode(F.expr("sequence(1, words - size + 1)"))).select(
        "lang", F.expr("array_join(slice(split(phrase, ' '), start, size), ' ')").alias("phrase"), "around")
    around = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = lowest.join(around, ["lang", "phrase"], "left").filter("around is null or cast(around as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * 80")

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))


ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM documents),
places AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4)) AS v(m) WHERE len(w) >= m),
grams AS (SELECT lang, m, w[i : i + m - 1] AS ws, count(*) AS f FROM places GROUP BY 1, 2, 3),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE m = 1 GROUP BY 1),
cand AS (SELECT * FROM grams WHERE m > 1 AND f >= 30),
cuts AS (SELECT c.*, k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.f // (x.f + y.f) AS BIGINT) AS score
  FROM cand c JOIN (VALUES (1), (2), (3)) AS q(k) ON q.k < c.m
  JOIN grams x ON x.lang = c.lang AND x.ws = c.ws[1:k] JOIN grams y ON y.lang = c.lang AND y.ws = c.ws[k + 1:c.m]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inner_ AS (SELECT lang, ws[s : s + z - 1] AS ws, max(f) AS around
  FROM cand, (VALUES (2), (3)) AS a(z), (VALUES (1), (2), (3)) AS b(s) WHERE z < m AND s + z - 1 <= m GROUP BY 1, 2),
kept AS (SELECT c.*, array_to_string(c.ws, ' ') AS phrase FROM lowest c LEFT JOIN inner_ i ON i.lang = c.lang AND i.ws = c.ws
  WHERE i.around IS NULL OR 100 * i.around < 80 * c.f)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, f DESC, phrase) AS rank, phrase, f AS a, l, r, n, score
FROM kept k JOIN totals t ON t.lang = k.lang QUALIFY rank <= 2000"""
