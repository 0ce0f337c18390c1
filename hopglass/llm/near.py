"""Operator 4: near-duplicate documents by MinHash, bands and odd sketches.

A document's set is its distinct 5-word shingles (A-Z lower-cased), as 64-bit hashes.  Documents with equal sets are one
class, represented by a row of its smallest doc_id (a node; its number is a row number, so an id may stand at several
texts).  Of each set PERMUTATIONS MinHash samples are taken; ROWS samples make a band
key, and all samples (number, value) are folded by parity into an odd sketch of SKETCH_BITS bits.  Two representatives
that share a band are candidates if the population count of the XOR of their sketches is at most XOR_LIMIT (six
standard deviations above what a similarity of 0.75 gives, mean 68, deviation 9) and the XOR of the parity bitmaps of their
whole sets (PARITY_BITS bits) has no more ones than two linked sets of their sizes can differ in, which no link fails;
candidates are confirmed on their full sets.

No group's pairs are all emitted.  Each band key first compares one leader with its members; the confirmed links give
components.  While a key still holds members of several components, more of its members lead (GROWTH times as many each
round, drawn by a hash of doc_id) and meet the members of other components only, a pair once in a round where the leader leads in one of the first HEAD bands that they share.  A key is finished when its members are
one component or all have led, so every candidate pair is either compared or already connected, and no link that the
bands show is lost but to the sketch.  At a similarity of 0.75 a pair shares no band with probability
(1 - 0.75**ROWS)**BANDS = 2.5e-7, and its sketches differ in more than XOR_LIMIT bits with probability 4.5e-9: a link is
missed with probability < 1e-6, both together.

Texts without words (and null texts) have an empty set and are linked with nothing.  Rows without a doc_id take no part:
component_id null, kept.  Repeated rows are copies; of each component one row is kept, of its smallest id, and if that
repeats, of the smallest text digest.  Different texts under one id are told apart: each has its own component and its own
verdict, though component_id, the smallest id of a component, may then be the same for both.  An empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, lower_words_of, steps, table_cut
from .text_stats import Numbers

WORDS, BANDS, ROWS, SKETCH_BITS, XOR_LIMIT, GROWTH = 5, 40, 4, 512, 122, 8
PARITY_BITS = 1024
PERMUTATIONS = BANDS * ROWS
#: Bands by which pairs that share several are told apart.
HEAD = 8
#: So many pairs (16 bytes each) are broadcast; more are joined by a shuffle.
FEW_PAIRS = 200_000
#: Bits of the map of wanted rows that is broadcast, 4 MB at most whatever the data size.
SLOTS = 1 << 25
_RNG = np.random.default_rng(20_240_501)
FACTORS, FLIPS = _RNG.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1), _RNG.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
STEP_FACTORS = _RNG.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(32)


class _Hashes(Numbers):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: str, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of the whole sequence, if there are fewer words."""
    words = lower_words_of(text)
    if len(hashes) > 400_000:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        n = max(1, len(h) - WORDS + 1)
        own = np.full(n, np.uint64(min(len(h), WORDS)))
        for k in range(min(len(h), WORDS)):
            own += mixed(h[k : k + n] + STEP_FACTORS[k]) * STEP_FACTORS[k]
    return np.unique(mixed(own))


def samples(own: np.ndarray) -> np.ndarray:
    """MinHash values of a set, one per permutation."""
    low, best = (own >> np.uint64(32)).astype(np.uint32), np.full(PERMUTATIONS, np.uint32(0xFFFFFFFF))
    for k in range(0, len(low), 2048):
        best = np.minimum(best, ((low[k : k + 2048, None] ^ FLIPS) * FACTORS).min(0))
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, of which its number is a part; best: rows of samples."""
    with np.errstate(over="ignore"):
        part = best.reshape(len(best), BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), part.shape[:2]).copy()
        for r in range(ROWS):
            key = mixed(key * np.uint64(0x2545F4914F6CDD1D) + part[:, :, r] + np.uint64(r))
    return key.view(np.int64)


def odd_sketches(best: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples (number, value), as 64-bit words."""
    bit = mixed(best.astype(np.uint64) << np.uint64(16) | np.arange(PERMUTATIONS, dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    at = np.arange(len(best))[:, None] * SKETCH_BITS + bit.astype(np.int64)
    odd = np.bincount(at.ravel(), minlength=len(best) * SKETCH_BITS).reshape(len(best), SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps of whole sets, as 64-bit words; the XOR of two has at most as many ones as the sets differ in."""
    odd = np.array([np.bincount((s % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1 for s in sets], np.uint8).reshape(-1, PARITY_BITS)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def estimate(ones: np.ndarray | float) -> np.ndarray | float:
    """Similarity that the odd sketches' differing bits show."""
    return 1 + SKETCH_BITS / (4 * PERMUTATIONS) * np.log(np.maximum(1 - 2 * np.asarray(ones) / SKETCH_BITS, 1e-9))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, digest of the set (null if empty), sketch, parity bitmap and band keys of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for keys, texts in steps(batches):
            own = [shingles(t, hashes) for t in texts]
            best = np.array([samples(s) for s in own], np.uint32).reshape(-1, PERMUTATIONS)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in own]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([hashlib.md5(t.encode()).digest() for t in texts], pa.binary()), pa.array([len(s) for s in own], pa.int64()), pa.array(digest, pa.binary()), pa.array(list(odd_sketches(best)), pa.list_(pa.int64())), pa.array(list(parities(own)), pa.list_(pa.int64())), pa.array(list(band_keys(best)), pa.list_(pa.int64()))],
                                             ["doc_id", "text_key", "n_shingles", "digest", "sketch", "parity", "bands"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, text_key binary, n_shingles long, digest binary, sketch array<long>, parity array<long>, bands array<long>")


def text_key() -> F.Column:
    """Digest of the text, as in ``signatures``; with doc_id it tells rows apart."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def sets(texts: DataFrame) -> DataFrame:
    """node and set (sorted array of hashes) of rows (node, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for keys, texts in steps(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([shingles(t, hashes).view(np.int64) for t in texts], pa.list_(pa.int64()))], ["node", "own"])

    return texts.mapInArrow(run, "node long, own array<long>")


def marked(texts: DataFrame, wanted: DataFrame, out: str, keys: tuple[str, str] = ("doc_id", "text_key")) -> DataFrame:
    """Adds whether a row's keys may be among those of ``wanted``: true for all that are, and for few others (those that
    share a bit of a map of SLOTS bits)."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS))
    bits = wanted.groupBy(F.bitmap_bucket_number(slot).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("__bits"))
    held = texts.withColumn("__slot", slot).join(F.broadcast(bits), F.bitmap_bucket_number("__slot") == F.col("__bucket"), "left")
    at = "conv(hex(substring(__bits, cast(bitmap_bit_position(__slot) div 8 as int) + 1, 1)), 16, 10)"
    return held.withColumn(out, F.expr(f"coalesce((shiftright(cast({at} as int), cast(bitmap_bit_position(__slot) % 8 as int)) & 1) = 1, false)")).drop("__slot", "__bucket", "__bits")


def likely(texts: DataFrame, wanted: DataFrame, keys: tuple[str, str] = ("doc_id", "text_key")) -> DataFrame:
    """The rows of ``texts`` that may be among ``wanted`` (see ``marked``), so that texts that no later join needs are not moved."""
    return marked(texts, wanted, "__likely", keys).filter("__likely").drop("__likely")


def linked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): nodes with the smallest node that edges (a, b) reach; labels spread along edges and then jump to the
    label of their label, until nothing changes."""
    both = table_cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = table_cut(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low")).withColumnRenamed("a", "node")
        spread = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("root"))
        spread = table_cut(spread.join(jump, "label", "left").select("node", F.least("label", "root").alias("label"), (F.least("label", "root") < F.col("was")).alias("moved")))
        labels = spread.select("node", "label")
        if spread.filter("moved").isEmpty():
            return labels


def confirmed(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.  Few pairs (their number is checked) are broadcast to the sets, and
    only sets that stand in a pair are moved."""
    pairs = table_cut(pairs)
    few = pairs.count() <= FEW_PAIRS
    side = F.broadcast(pairs) if few else pairs
    held = whole.join(side, whole["node"] == side["a"]).select("a", "b", F.col("own").alias("xa"))
    seconds = pairs.select(F.col("b").alias("node")).distinct()
    others = whole.join(F.broadcast(seconds), "node", "left_semi") if few else whole
    both = F.size(F.array_intersect("xa", "own"))
    return others.join(held, others["node"] == held["b"]).filter(100 * both >= percent * (F.size("xa") + F.size("own") - both)).select("a", "b").distinct()


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after the links (a, b) between nodes have joined components."""
    at_a, at_b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    merged = table_cut(links.join(at_a, "a").join(at_b, "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    if merged.isEmpty():
        return labels
    roots = linked(merged, merged.select(F.col("a").alias("node")).union(merged.select(F.col("b").alias("node"))).distinct())
    return table_cut(labels.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label")))


def differing(a: str, b: str, bits: int) -> F.Column:
    """Population count of the XOR of two sketches or bitmaps."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(bits // 64)), F.lit(0))


def possible(percent: int) -> F.Column:
    """Whether sizes (na, nb), sketches (sa, sb) and parity bitmaps (qa, qb) allow a link: linked sets differ in at most
    (100 - percent) / (100 + percent) of the sum of their sizes."""
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return sizes & (differing("sa", "sb", SKETCH_BITS) <= XOR_LIMIT) & ((100 + percent) * differing("qa", "qb", PARITY_BITS) <= (100 - percent) * (F.col("na") + F.col("nb")))


def decided(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept of every row."""
    texts = id_and_text(docs).withColumn("text_key", text_key())
    all_rows = table_cut(signatures(docs).withColumn("row", F.monotonically_increasing_id()))
    own = all_rows.filter("doc_id is not null and digest is not null")
    classes = table_cut(own.groupBy("digest").agg(F.min("doc_id").alias("low"), F.min_by("row", "doc_id").alias("rep")))
    reps = own.filter("n_shingles > 1").join(classes, own["row"] == classes["rep"], "left_semi")
    rank = F.xxhash64("rep")
    bands = reps.select(F.col("row").alias("rep"), F.explode("bands").alias("band")).repartition("band")  # one exchange serves both uses below
    shared = bands.groupBy("band").agg(F.count("*").alias("size"), F.min(rank).alias("lowest")).filter("size > 1")
    members = table_cut(bands.join(shared, "band").select("band", "size", "rep", (rank == F.col("lowest")).alias("first")))
    nodes = table_cut(members.select("rep").distinct())
    sketches = table_cut(reps.join(nodes, reps["row"] == nodes["rep"], "left_semi").select(F.col("row").alias("node"), "doc_id", "text_key", "n_shingles", "sketch", "parity", F.slice("bands", 1, HEAD).alias("head")))
    in_head = members.join(sketches, members["rep"] == sketches["node"]).filter(F.array_contains("head", F.col("band")))
    heads = in_head.groupBy("rep").agg(F.collect_list(F.struct("band", "size")).alias("heads"))  # HEAD entries at most
    sketches = table_cut(sketches.join(heads, sketches["node"] == heads["rep"], "left").select("node", "doc_id", "text_key", "n_shingles", "sketch", "parity", *(F.coalesce(f"heads.{c}", F.array().cast("array<bigint>")).alias(f"head_{c}s") for c in ("band", "size"))))
    wanted = sketches.select("node", "doc_id", "text_key")
    whole = table_cut(sets(likely(texts, wanted).join(wanted, ["doc_id", "text_key"]).select("node", "text")))
    if whole.count() > nodes.count():  # rows that repeat a node's id and text
        more = whole.groupBy("node").count().filter("count > 1").select("node")
        whole = table_cut(whole.join(more, "node", "left_anti").union(whole.join(more, "node", "left_semi").groupBy("node").agg(F.first("own").alias("own"))))
    labels = nodes.select(F.col("rep").alias("node"), F.col("rep").alias("label"))

    # first round: each band's members meet its first one
    firsts = members.filter("first").select("band", F.col("rep").alias("a"))
    pairs = members.filter("not first").select("band", F.col("rep").alias("b")).join(firsts, "band").filter("a <> b").select("a", "b").distinct()
    sa, sb = (sketches.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), F.col("parity").alias(f"q{x}")) for x in "ab")
    labels = relabelled(labels, confirmed(pairs.join(sa, "a").join(sb, "b").filter(possible(percent)).select("a", "b"), whole, percent))

    # further rounds: more members lead, against members of other components, in the bands that the first round left undecided
    rows = members.filter("size > 2").join(labels, members["rep"] == labels["node"]).select("band", "size", "rep", "label")
    undecided = rows.groupBy("band").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1").select("band")
    rows = table_cut(rows.join(undecided, "band", "left_semi").drop("label"))
    draw = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)  # times a band's size: a member's place in it
    led, leaders, largest = 0, GROWTH, rows.agg(F.max("size")).first()[0] or 0
    while led < largest:
        wide = rows.filter(F.col("size") > led).join(labels, rows["rep"] == labels["node"]).join(sketches, rows["rep"] == sketches["node"])
        wide = wide.select("band", "size", "rep", "label", "n_shingles", "sketch", "parity", "head_bands", "head_sizes", draw.alias("draw"))
        leads = lambda size: (F.col("draw") * size >= led) & (F.col("draw") * size < leaders)  # noqa: B023, E731
        a = wide.filter(leads(F.col("size"))).select("band", F.col("rep").alias("a"), F.col("label").alias("la"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"), F.col("parity").alias("qa"), F.filter("head_bands", lambda _, i: leads(F.get("head_sizes", i))).alias("ba"))
        b = wide.select("band", F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"), F.col("parity").alias("qb"), F.col("head_bands").alias("bb"))
        # a leader meets a member once, if it leads in one of the first HEAD bands that they share
        shared_head = F.array_intersect("ba", "bb")
        meet = (F.size(shared_head) == 0) | (F.get(shared_head, F.lit(0)) == a["band"])
        pairs = a.join(b, (a["band"] == b["band"]) & (F.col("la") != F.col("lb")) & possible(percent) & meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        labels = relabelled(labels, confirmed(pairs, whole, percent))
        led, leaders = leaders, leaders * GROWTH

    member_of = table_cut(classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "low", F.coalesce("label", "rep").alias("label")))
    member_of = member_of.join(member_of.groupBy("label").agg(F.min("low").alias("found")), "label").select("digest", "label", "found")
    out = all_rows.select("row", "doc_id", "text_key", "n_shingles", "digest").join(member_of, "digest", "left")
    out = table_cut(out.select("row", "doc_id", "text_key", "n_shingles", "label", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id")))
    first = out.filter("doc_id = component_id").groupBy("label", "doc_id").agg(F.min(F.struct("text_key", "row")).alias("low")).select(F.col("low.row").alias("row"), F.lit(True).alias("first"))
    return out.join(first, "row", "left").select("doc_id", "text_key", "n_shingles", "component_id", F.coalesce("first", F.col("doc_id").isNull()).alias("kept"))


def components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return decided(docs, percent).drop("text_key")


def without_copies(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each group, with the columns of ``docs``; of rows that repeat a kept id too, one.

    Rows stay where they are: a map of the keys that leave and one of the other keys that share a bit with them tell all
    rows apart but those that are in both maps, and only these few are joined."""
    keys = ("__id", "__key")
    found = decided(docs, percent).filter("doc_id is not null").withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    found = table_cut(found.groupBy(*keys).agg(F.max("kept").alias("__kept"), F.count("*").alias("__n")).withColumn("__leaves", F.expr("not __kept or __n > 1")))
    leaving = found.filter("__leaves").select(*keys)
    staying = table_cut(likely(found.filter("not __leaves").select(*keys), leaving, keys))
    rows = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__key", text_key())
    told = marked(marked(rows, leaving, "__in", keys), staying, "__out", keys)
    out = told.filter("__id is null or not __in").drop("__in", "__out")
    out = out.unionByName(told.filter("__id is not null and __in and __out").drop("__in", "__out").join(leaving, list(keys), "left_anti"))
    repeated = found.filter("__leaves and __kept").select(*keys)
    if not repeated.isEmpty():
        out = out.unionByName(likely(rows, repeated, keys).join(repeated, list(keys), "left_semi").dropDuplicates(list(keys)))
    return out.drop(*keys)
