"""Operator 12: n-gram Jaccard join by filters under several global token orders.

A document's set is its distinct 4-word shingles (A-Z lower-cased), as 64-bit hashes; with fewer words, the whole sequence as one.
Documents with equal sets are one class, represented by one row (a node).  Two sets link when 100 * intersection >= PERCENT * union.

A set of n tokens can miss at most n - ceil(PERCENT * n / 100) = s of them in a partner, whatever the order of the tokens, so
* of any tokens chosen by their hash alone, more than s that occur nowhere else rule the document out (the tokens of
  SHARE of the hash range are counted over all classes, then all tokens of those that are left; the rest is the active part);
* two linked sets share one of their first s + 1 tokens (prefix) under every global order.  Orders: rising document frequency among the
  active sets (the inverted lists are built on it, so they are lists of rare tokens), rising hash, falling hash.
  Candidates of a list must share prefix tokens under the other orders too before they are verified on their full sets;
* the XOR of two parity bitmaps of whole sets has at most as many ones as the sets differ in, which with the sizes bounds the similarity.

Lists of more than BLOCK members are dealt out by pairs of blocks.  A list first gives a forest of its candidates (a spanning
forest: never all pairs of a group), whose confirmed links make components; then every candidate pair between two components that was
not compared yet is verified.  So each link is either confirmed or lies inside a component, and nothing is capped or estimated.

Texts without words and null texts have an empty set and link with nothing.  Rows without a doc_id take no part: component_id null.
Repeated rows and equal texts are one class.  component_id is the smallest doc_id of the component.  Further columns are left behind.  An
empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopglass.operators.skew import HOT_ROWS, join_on_hot_key

from .common import id_and_text, lower_words_of, steps, table_cut
from .near import STEP_FACTORS, _Hashes, linked, mixed, relabelled, text_key
from .phrases import FILTER_BITS, bitmap_of, let_through

WORDS, PERCENT = 4, 85
#: Share of the hash range whose tokens decide which documents are active.
SHARE = 0.22
#: Tokens behind one hash partition of the count.
BUCKET_TOKENS, LEAST_BUCKETS = 1 << 20, 64
#: Members of an inverted list that meet inside one task at a time.
BLOCK = 1024
#: 64-bit words of the parity bitmaps, by set size: the larger ones from LARGE tokens on.
NARROW, WIDE, LARGE = 16, 64, 512


def shingles(text: str, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of WORDS words; of the whole sequence, if there are fewer."""
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


def slack(n: Column, percent: int) -> Column:
    """How many of n tokens can be missing in a partner."""
    return n - F.ceil(n * percent / F.lit(100)).cast("long")


def signatures(docs: DataFrame, share: float) -> DataFrame:
    """doc_id, text_key, n_shingles, digest of the set (null if empty), class (63 bits of it) and its tokens in the first ``share`` of the
    hash range."""
    end = np.uint64(min(int(share * 2.0**64), 2**64 - 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for keys, texts in steps(batches):
            own = [shingles(t, hashes) for t in texts]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in own]
            number = [None if d is None else int.from_bytes(d[:8], "little") >> 1 for d in digest]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([hashlib.md5(t.encode()).digest() for t in texts], pa.binary()), pa.array([len(s) for s in own], pa.int64()), pa.array(digest, pa.binary()), pa.array(number, pa.int64()),
                                              pa.array([s[: np.searchsorted(s, end)].view(np.int64) for s in own], pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "digest", "class", "tokens"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, text_key binary, n_shingles long, digest binary, class long, tokens array<long>")


def holders(token: np.ndarray, held_by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens, the one class that holds each (-1: several), and the place of the first occurrence."""
    order = np.argsort(token, kind="stable")
    token, held_by = token[order], held_by[order]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    low, high = np.minimum.reduceat(held_by, first), np.maximum.reduceat(held_by, first)
    return token[first], np.where(low == high, low, -1), order[first]


def tokens_alone(sets: DataFrame, buckets: int) -> DataFrame:
    """class and how many of its tokens no other class holds; ``sets``: class (not negative), tokens.  A class may come in many rows.

    Tokens are dealt to hash partitions, packed by step in the order of their sets, so that classes take hardly any room.  A token of
    several classes in a step is sent once, without a class, so a popular one is one entry per step."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, sizes = batch.column(1).flatten().to_numpy(), batch.column(1).value_lengths().to_numpy()
            if not len(token):
                continue
            own, held_by, place = holders(token, np.repeat(batch.column(0).to_numpy(), sizes))
            bucket = ((own.view(np.uint64) & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((place, bucket))
            own, held_by, bucket = own[order], held_by[order], bucket[order]
            start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            edges = pa.array(np.append(start, len(own)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[start]), pa.ListArray.from_arrays(edges, pa.array(own)), pa.ListArray.from_arrays(edges, pa.array(held_by))], ["bucket", "tokens", "classes"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(tokens, classes):
            _, held_by, _ = holders(np.concatenate(tokens), np.concatenate(classes))
            found, n = np.unique(held_by[held_by >= 0], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["class", "alone"])

        at, tokens, classes = None, [], []
        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != at:
                    if at is not None:
                        yield done(tokens, classes)
                    at, tokens, classes = bucket, [], []
                tokens.append(batch.column(1)[i].values.to_numpy())
                classes.append(batch.column(2)[i].values.to_numpy())
        if at is not None:
            yield done(tokens, classes)

    packed = sets.select("class", "tokens").mapInArrow(pack, "bucket int, tokens array<long>, classes array<long>")
    counts = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "class long, alone long")
    return counts.groupBy("class").agg(F.sum("alone").alias("alone"))


def can_have_partners(sets: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The rows (class, n_shingles) of which no more tokens are held by no other class than a partner can miss."""
    total = sets.agg(F.sum(F.size("tokens"))).first()[0] or 0
    alone = tokens_alone(sets, max(LEAST_BUCKETS, total // BUCKET_TOKENS + 1))
    small = -(-percent // (100 - percent))  # smaller sets have no partner but themselves
    rows = rows.filter(F.col("n_shingles") >= small).join(alone, "class", "left")
    return rows.filter(F.coalesce("alone", F.lit(0)) <= slack(F.col("n_shingles"), percent)).drop("alone")


def whole_sets(docs: DataFrame, active: DataFrame, filter_bits: int) -> DataFrame:
    """node and own (sorted array of hashes) of the active nodes; a bitmap of fixed size keeps most other texts from being moved."""
    keyed = active.withColumn("key", F.xxhash64("doc_id", "text_key"))
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(keyed.select("key"), filter_bits).tobytes())

    def passing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            yield batch.filter(pa.array(let_through(known, batch.column(0).to_numpy().view(np.uint64))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for keys, texts in steps(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([shingles(t, hashes).view(np.int64) for t in texts], pa.list_(pa.int64()))], ["node", "own"])

    texts = id_and_text(docs).withColumn("text_key", text_key()).select(F.xxhash64("doc_id", "text_key").alias("key"), "doc_id", "text_key", "text")
    texts = texts.mapInArrow(passing, texts.schema).dropDuplicates(["doc_id", "text_key"]).join(active, ["doc_id", "text_key"])
    return texts.select("node", "text").mapInArrow(run, "node long, own array<long>")


def prefixes(whole: DataFrame, percent: int) -> DataFrame:
    """node, n and prefix under the order of rising document frequency, without the tokens that occur in no other set."""
    tokens = whole.select("node", F.explode("own").alias("token"))
    shared = table_cut(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"))
    held = join_on_hot_key(tokens, shared, ["token"], shared.filter(F.col("df") > HOT_ROWS).select("token"))
    held = held.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))  # one document's tokens at most
    n, common = F.col("n"), F.size("shared")
    take = slack(n, percent) + 1 - (n - common)  # tokens of no other set come first in this order
    return (whole.select("node", F.size("own").cast("long").alias("n")).join(held, "node").filter(take > 0)
            .select("node", "n", F.transform(F.slice("shared", F.lit(1), F.greatest(take, F.lit(0)).cast("int")), lambda x: x["token"]).alias("prefix")))


def parity(own: np.ndarray, words: int) -> np.ndarray:
    """Bitmap of ``words`` 64-bit words with a bit for each slot that an odd number of tokens fall into."""
    odd = np.bincount((own % np.uint64(words * 64)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def narrowed(bits: np.ndarray, words: int) -> np.ndarray:
    """The parity bitmap that fewer words would have given."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def bitmaps(whole: DataFrame) -> DataFrame:
    """node, n, bits of the parity bitmap."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x.values.to_numpy().view(np.uint64) for x in batch.column(1)]
            bits = [parity(x, NARROW if len(x) < LARGE else WIDE).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array(bits, pa.binary())], ["node", "n", "bits"])

    return whole.select("node", "own").mapInArrow(run, "node long, n long, bits binary")


class List:
    """Members of one inverted list (or of two of its blocks) in the order of their nodes."""

    def __init__(self, nodes: np.ndarray, n: np.ndarray, bits: list[bytes], blocks: np.ndarray, labels: np.ndarray, percent: int):
        order = np.argsort(nodes)
        self.nodes, self.n, self.blocks, self.labels, self.percent = nodes[order], n[order], blocks[order], labels[order], percent
        self.across = bool((self.blocks != self.blocks[0]).any())
        self.wide = self.n >= LARGE
        self.narrow_bits = np.zeros((len(nodes), NARROW), np.uint64)
        held = [bits[i] for i in order.tolist()]
        for mask, words in ((~self.wide, NARROW), (self.wide, WIDE)):
            at = np.flatnonzero(mask)
            if len(at):
                own = np.frombuffer(b"".join(held[i] for i in at.tolist()), np.uint64).reshape(len(at), words)
                self.narrow_bits[at] = narrowed(own, NARROW)
                if words == WIDE:
                    self.wide_bits, self.wide_at = own, at

    def partners(self, i: int, others: np.ndarray) -> np.ndarray:
        """Of the members ``others``, those that sizes and bitmaps allow as partners of member i."""
        n, own = self.n[others], self.n[i]
        ok = 100 * np.minimum(n, own) >= self.percent * np.maximum(n, own)
        if self.across:
            ok &= self.blocks[others] != self.blocks[i]
        others = others[ok]
        most = (100 - self.percent) * (self.n[others] + own)
        others = others[(100 + self.percent) * np.bitwise_count(self.narrow_bits[others] ^ self.narrow_bits[i]).sum(1, dtype=np.int64) <= most]
        if self.wide[i] and len(others):
            both = others[self.wide[others]]
            place = lambda x: np.searchsorted(self.wide_at, x)
            far = np.bitwise_count(self.wide_bits[place(both)] ^ self.wide_bits[place(i)]).sum(1, dtype=np.int64)
            others = np.setdiff1d(others, both[(100 + self.percent) * far > (100 - self.percent) * (self.n[both] + own)], assume_unique=True)
        return others

    def forest(self) -> list[tuple[int, int]]:
        """Edges of a spanning forest of the candidate pairs, by breadth from the smallest node."""
        out, left, queue = [], np.arange(len(self.nodes)), []
        while len(left):
            if not queue:
                queue, left = [int(left[0])], left[1:]
            i = queue.pop(0)
            found = self.partners(i, left)
            if len(found):
                left = np.setdiff1d(left, found, assume_unique=True)
                queue += found.tolist()
                out += [(int(self.nodes[i]), int(self.nodes[j])) for j in found]
        return out

    def between(self) -> list[tuple[int, int]]:
        """All candidate pairs of members in different components."""
        out, every = [], np.arange(len(self.nodes))
        if (self.labels == self.labels[0]).all():
            return out
        for i in range(len(every) - 1):
            rest = every[i + 1 :]
            out += [(int(self.nodes[i]), int(self.nodes[j])) for j in self.partners(i, rest[self.labels[rest] != self.labels[i]])]
        return out


def candidates(members: DataFrame, bits: DataFrame, labels: DataFrame, percent: int, block: int, first: bool) -> DataFrame:
    """Pairs a < b of nodes that share a list and pass sizes and bitmaps: a forest of each list (first round), or all between components."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows):
            found = List(*(np.concatenate([r[k] for r in rows]) for k in (0, 1)), [b for r in rows for b in r[2]], *(np.concatenate([r[k] for r in rows]) for k in (3, 4)), percent)
            edges = found.forest() if first else found.between()
            return pa.RecordBatch.from_arrays([pa.array([min(e) for e in edges], pa.int64()), pa.array([max(e) for e in edges], pa.int64())], ["a", "b"])

        key, rows = None, []
        for batch in batches:
            token, low, high, node, n, own_block, label = (batch.column(i).to_numpy() for i in (0, 1, 2, 3, 4, 6, 7))
            same = (token[1:] == token[:-1]) & (low[1:] == low[:-1]) & (high[1:] == high[:-1])
            edges = [0, *(np.flatnonzero(~same) + 1).tolist(), len(token)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if (token[i], low[i], high[i]) != key:
                    if sum(len(r[0]) for r in rows) > 1:
                        yield pairs(rows)
                    key, rows = (token[i], low[i], high[i]), []
                rows.append((node[i:j], n[i:j], batch.column(5).slice(i, j - i).to_pylist(), own_block[i:j], label[i:j]))
        if sum(len(r[0]) for r in rows) > 1:
            yield pairs(rows)

    blocks = F.ceil(F.col("size") / block).cast("int")
    rows = members.join(labels, "node").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    if not first:
        mixed_lists = rows.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1").select("token")
        rows = rows.join(mixed_lists, "token", "left_semi")
    rows = rows.join(bits, "node").withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "n", "bits", "block", "label")
    return rows.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high").mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs that share prefix tokens under rising and under falling hashes, and then prove similar on their full sets."""
    hot = pairs.groupBy("a").count().filter(F.col("count") > HOT_ROWS).select("a")
    held = join_on_hot_key(pairs, whole.select(F.col("node").alias("a"), F.col("own").alias("xa")), ["a"], hot)
    both = held.join(whole.select(F.col("node").alias("b"), F.col("own").alias("xb")), "b")
    cut = lambda x: (slack(F.size(x), percent) + 1).cast("int")
    rising = F.arrays_overlap(F.slice("xa", F.lit(1), cut("xa")), F.slice("xb", F.lit(1), cut("xb")))
    falling = F.arrays_overlap(F.slice("xa", -cut("xa"), cut("xa")), F.slice("xb", -cut("xb"), cut("xb")))
    shared = F.size(F.array_intersect("xa", "xb"))
    return both.filter(rising & falling).filter(100 * shared >= percent * (F.size("xa") + F.size("xb") - shared)).select("a", "b")


def joined(docs: DataFrame, percent: int = PERCENT, share: float = SHARE, block: int = BLOCK, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    every = table_cut(signatures(docs, share).withColumn("node", F.monotonically_increasing_id()))
    own = every.filter("doc_id is not null and digest is not null")
    classes = table_cut(own.groupBy("digest").agg(F.min("doc_id").alias("low"), F.min_by("node", "doc_id").alias("rep"), F.count("*").alias("rows")))
    reps = own.drop("tokens").join(classes.select(F.col("rep").alias("node")), "node", "left_semi")
    active = table_cut(can_have_partners(own, reps, percent).select("node", "doc_id", "text_key"))
    whole = table_cut(whole_sets(docs, active, filter_bits))
    sizes = whole.select(F.col("node").alias("class"), F.size("own").cast("long").alias("n_shingles"))
    closer = can_have_partners(whole.select(F.col("node").alias("class"), F.col("own").alias("tokens")), sizes, percent)  # again, by whole sets
    whole = table_cut(whole.join(closer.select(F.col("class").alias("node")), "node", "left_semi"))
    listed = table_cut(prefixes(whole, percent).select("node", F.explode("prefix").alias("token")))
    members = table_cut(listed.join(listed.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1"), "token").select("token", "size", "node"))
    nodes = members.select("node").distinct()
    labels = table_cut(nodes.select("node", F.col("node").alias("label")))
    bits = table_cut(bitmaps(whole.join(nodes, "node", "left_semi")))

    compared = table_cut(candidates(members, bits, labels, percent, block, True))
    links = table_cut(confirmed(compared, whole, percent))
    labels = table_cut(linked(links, labels))
    rest = table_cut(candidates(members, bits, labels, percent, block, False).join(compared, ["a", "b"], "left_anti"))
    labels = relabelled(labels, table_cut(confirmed(rest, whole, percent)))

    of = classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("digest", "low", "rows", F.coalesce("label", "rep").alias("label"))
    of = table_cut(of)
    found = of.join(of.groupBy("label").agg(F.min("low").alias("component")), "label").select("digest", "component")
    hot = classes.filter(F.col("rows") > HOT_ROWS).select("digest")
    kept = join_on_hot_key(own.select("doc_id", "n_shingles", "digest"), found, ["digest"], hot).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    bare = every.filter("doc_id is null or digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return kept.unionByName(bare)


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.doc_id WHERE r.low < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(low) AS component_id FROM r GROUP BY 1) c ON c.doc_id = d.doc_id"""
