"""N-gram Jaccard join by PartEnum signatures, and its groups.

Two sets with similarity p/100 or more differ in at most (|a| + |b|) (100 - p) / (100 + p)
elements, and the smaller has at least p/100 of the larger's size.  Sets are dealt into
bands of nearly equal size; a set takes part in the band of its own size and in the one
below where a smaller partner may stand.  In a band that allows k differences the domain is
split into n1 parts by hash, and each part into n2 subparts.  Two linked sets differ by at
most one element in some part, so they agree on one subset of n2 - 1 of its subparts: the
hash of a set's elements in every such subset is a signature.

There are a few parts more than the pigeonhole needs.  A set with no more parts that have an
empty subset than there are spare ones leaves its empty subsets out: it agrees with each
partner on a subset of another part as well, which is empty for neither.  Empty projections
would otherwise meet in one large bucket.

Signatures lead to candidates, candidates are verified on their true sets:

1. Of each bucket only the pairs with its hub (the set with most shared signatures) are
   tried, which settles groups of near copies without pairs within them.
2. For sets of a bucket that are not connected by then, all pairs are tried.

Pairs whose sizes or parity sketches rule a link out are dropped before texts are joined:
each element flips one bit of a set's sketch, so two sketches differ in no more bits than
the sets in elements, and no link is lost.  A sketch of one width says nothing of sets that
are larger than it: those have a wide sketch besides, as wide as they are large.  Pairs that
it lets through are nearly all links, so only their texts travel.

Equal sets are one node from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from ._spark import columns, numbered, prepare, stored
from .components import connected_components

_SHINGLE, _PART, _SUB, _SECOND = 0xC2B2AE3D27D4EB4F, K.U64(0x27D4EB2F165667C5), K.U64(0x85EBCA77C2B2AE63), K.U64(0x165667B19E3779F9)
#: Words of a node's parity sketch.
SKETCH_WORDS = 16


def shingle_sets(column: pa.Array, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their bounds.  Words are lower-cased
    (A-Z); fewer than ``ngram`` words are one shingle, none are none."""
    w = K.words(K.texts(column))
    h = w.hashes(lower=True)
    at = K.windows(w.first, ngram)
    short = np.flatnonzero((w.counts > 0) & (w.counts < ngram))
    starts, ends = np.concatenate((at, w.first[short])), np.concatenate((at + ngram, w.first[short + 1]))
    g = K.spans_hash(h, starts, ends, _SHINGLE)
    doc = np.searchsorted(w.first, starts, side="right") - 1
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]))) if len(g) else np.zeros(0, bool)
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(w.first)))


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, K.U64), np.cumsum(x, dtype=K.U64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def set_hashes(g: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, each from a sum of its own over the elements."""
    n = np.diff(bounds).astype(K.U64)
    return K.mix(_sums(K.mix(g), bounds) + n), K.mix(_sums(K.mix(g ^ _SECOND), bounds) ^ n)


def set_names(g: np.ndarray, bounds: np.ndarray, shared: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit name of each set: its first hash, or one of both hashes where the first is
    among the ``shared`` ones, which different sets have."""
    a, b = set_hashes(g, bounds)
    if shared is not None and len(shared):
        a = np.where(np.isin(a, shared), K.mix(K.mix(a) + b), a)
    return a


def max_difference(total: int, percent: int) -> int:
    """Elements in which two linked sets of ``total`` elements together can differ."""
    return total * (100 - percent) // (100 + percent)


class Bands:
    """Size bands and the differences that a pair found in each can have.  A band is at least
    as wide as linked sizes are apart, so a partner stands in the same band or the next."""

    def __init__(self, percent: int, ratio: float = 1.25):
        self.percent, self.ratio, self.edges, self.k = percent, max(ratio, 100 / percent), [1], []

    def upto(self, size: int) -> None:
        while self.edges[-1] <= size:
            low = self.edges[-1]
            high = max(low + 1, int(low * self.ratio))
            most = high - 1  # the largest smaller partner
            self.k.append(max_difference(most + most * 100 // self.percent, self.percent))
            self.edges.append(high)

    def of(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, band): every set's own band, and the one below if a partner may be there."""
        self.upto(int(sizes.max(initial=1)))
        edges = np.array(self.edges)
        own = np.searchsorted(edges, sizes, side="right") - 1
        below = np.flatnonzero((own > 0) & ((edges[own] - 1) * 100 >= sizes * self.percent))
        rows = np.flatnonzero(sizes > 0)
        return [(rows, own[rows]), (below, own[below] - 1)]


def partition_counts(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First-level parts for k differences, one of which two linked sets agree on but for
    one element, and the spare parts among them."""
    spare = np.where(k > 0, 1 + (k + 1) // 16, 0)
    return np.where(k > 0, k // 2 + 1 + spare, 1), spare


def signatures(g: np.ndarray, bounds: np.ndarray, bands: Bands, subparts: int) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of sets: (set, signature), some sets' empty projections left out."""
    sizes = np.diff(bounds)
    out_set, out_sig = [], []
    x = K.mix(g)
    for rows, band in bands.of(sizes):
        if not len(rows):
            continue
        k = np.array(bands.k)[band]
        n1, spare = partition_counts(k)
        n = sizes[rows]
        which = np.repeat(np.arange(len(rows)), n)
        element = np.repeat(bounds[rows] - (np.cumsum(n) - n), n) + np.arange(len(which))
        v = x[element]
        part = (K.mix(g[element] * _PART) % n1[which].astype(K.U64)).astype(np.int64)
        sub = np.where(k[which] > 0, (K.mix(g[element] ^ _SUB) % K.U64(subparts)).astype(np.int64), 0)
        first = np.concatenate(([0], np.cumsum(n1)))  # parts of each set, in a row
        cell = (first[which] + part) * subparts + sub
        total, count = np.zeros(first[-1] * subparts, K.U64), np.bincount(cell, minlength=first[-1] * subparts)
        np.add.at(total, cell, v)
        total, count = total.reshape(-1, subparts), count.reshape(-1, subparts)
        owner = np.repeat(np.arange(len(rows)), n1)
        part_no = np.arange(first[-1]) - first[owner]
        # Subset j leaves out subpart j; what sizes without differences have is the whole set.
        left = total.sum(axis=1, dtype=K.U64)[:, None] - total
        number = count.sum(axis=1)[:, None] - count
        exact = k[owner] == 0
        weak = (number == 0).any(axis=1) & ~exact
        few = (np.bincount(owner[weak], minlength=len(rows)) <= spare)[owner]
        for j in range(subparts):
            use = np.where(exact, j == 0, (number[:, j] > 0) | ~few)
            whole = np.where(exact, total.sum(axis=1, dtype=K.U64), left[:, j])
            tag = ((band[owner].astype(K.U64) << K.U64(40)) + (part_no.astype(K.U64) << K.U64(4)) + K.U64(j))[use]
            out_set.append(rows[owner[use]])
            out_sig.append(K.mix(whole[use] ^ K.mix(tag)))
    return np.concatenate(out_set or [np.zeros(0, np.int64)]), np.concatenate(out_sig or [np.zeros(0, K.U64)])


def _batch(**columns: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def sketch_bits(percent: int) -> int:
    """Bits of a sketch for an element of its set, a power of two: sketches of sets that share
    nothing then differ in half as many bits again as linked sets do at most."""
    bits = 1
    while bits < 8 and bits / 2 * (1 - math.exp(-4 / bits)) < 3 * (100 - percent) / (100 + percent):
        bits *= 2
    return bits


def wide_sketches(g: np.ndarray, bounds: np.ndarray, bits: int) -> list[bytes | None]:
    """Parity sketches of sets that 64 * SKETCH_WORDS bits are too few for; None for others.  A
    width is the power of two at or above ``bits`` an element, and a wider sketch, its halves
    laid over each other, is the narrower one of the same set."""
    out: list[bytes | None] = [None] * (len(bounds) - 1)
    for i in np.flatnonzero(np.diff(bounds) * bits > 64 * SKETCH_WORDS):
        x = K.mix(g[bounds[i] : bounds[i + 1]] ^ _PART)
        width = 1 << (len(x) * bits - 1).bit_length()
        flips = np.bincount((x & K.U64(width - 1)).astype(np.int64), minlength=width)
        out[i] = np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()
    return out


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two wide sketches differ at the narrower one's width."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.unpackbits(x ^ y).sum())


_SETS = "doc_id long, row_key long, row_sub int, n_shingles long, name long, second long, wide binary, " + ", ".join(f"b{i} long" for i in range(SKETCH_WORDS))


def _describe(ngram: int, percent: int, clashes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches):
            g, bounds = shingle_sets(b.column("text"), ngram)
            n = np.diff(bounds)
            bit = K.mix(g ^ _PART) % K.U64(64 * SKETCH_WORDS)
            sketch = np.zeros(len(n) * SKETCH_WORDS, K.U64)
            cell = np.repeat(np.arange(len(n)), n) * SKETCH_WORDS + (bit >> K.U64(6)).astype(np.int64)
            np.bitwise_xor.at(sketch, cell, K.U64(1) << (bit & K.U64(63)))
            sketch = K.signed(sketch).reshape(-1, SKETCH_WORDS)
            name, (_, second) = set_names(g, bounds, clashes), set_hashes(g, bounds)
            wide = wide_sketches(g, bounds, sketch_bits(percent))
            yield _batch(doc_id=(b.column("doc_id"), pa.int64()), row_key=(b.column("row_key"), pa.int64()), row_sub=(b.column("row_sub"), pa.int32()), n_shingles=(n, pa.int64()), name=(K.signed(name), pa.int64()), second=(K.signed(second), pa.int64()), wide=(wide, pa.binary()), **{f"b{i}": (sketch[:, i], pa.int64()) for i in range(SKETCH_WORDS)})

    return run


def _sign(ngram: int, percent: int, subparts: int, clashes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), np.zeros(0, K.U64)
        for b in K.pieces(batches):
            g, bounds = shingle_sets(b.column("text"), ngram)
            names = set_names(g, bounds, clashes)
            # Copies of one set in one task sign once.
            _, first = np.unique(names, return_index=True)
            fresh = np.zeros(len(names), bool)
            fresh[first] = True
            fresh &= ~np.isin(names, seen) & (np.diff(bounds) > 0)
            rows = np.flatnonzero(fresh)
            seen = np.union1d(seen, names[rows])
            n = np.diff(bounds)[rows]
            at = np.repeat(bounds[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            s, sig = signatures(g[at], np.concatenate(([0], np.cumsum(n))), bands, subparts)
            yield _batch(sig=(K.signed(sig), pa.int64()), node=(K.signed(names[rows][s]), pa.int64()))

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (sig, node) sorted by both: the distinct rows of signatures with two nodes or more.
    A stream with one row of state."""
    held, before = None, False
    for b in batches:
        sig, node = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(sig):
            continue
        if held is not None:
            sig, node = np.concatenate((held[0], sig)), np.concatenate((held[1], node))
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
        sig, node = sig[new], node[new]
        eq = sig[1:] == sig[:-1]
        hit = np.concatenate(([before], eq[:-1])) | eq if len(eq) else eq
        yield _batch(sig=(sig[:-1][hit], pa.int64()), node=(node[:-1][hit], pa.int64()))
        held, before = (sig[-1:], node[-1:]), bool(eq[-1]) if len(eq) else before
    if held is not None and before:
        yield _batch(sig=(held[0], pa.int64()), node=(held[1], pa.int64()))


def _named(ngram: int, clashes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches):
            names = K.signed(set_names(*shingle_sets(b.column("text"), ngram), clashes))
            same = pa.array(names == b.column("node").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("node").filter(same), b.column("text").filter(same)], names=["node", "text"])

    return run


def _verify(ngram: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches, "text_x", "text_y"):
            # A hub stands in many rows of a batch: its set is made once.
            x, y = b.column("x").to_numpy(), b.column("y").to_numpy()
            names, first, back = np.unique(x, return_index=True, return_inverse=True)
            gx, bx = shingle_sets(b.column("text_x").take(pa.array(first)), ngram)
            gy, by = shingle_sets(b.column("text_y"), ngram)
            nx, ny = np.diff(bx)[back], np.diff(by)
            at = np.repeat(bx[back] - (np.cumsum(nx) - nx), nx) + np.arange(nx.sum())
            pair = np.concatenate((np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(x)), ny)))
            g = np.concatenate((gx[at], gy))
            order = np.lexsort((g, pair))
            same = (g[order][1:] == g[order][:-1]) & (pair[order][1:] == pair[order][:-1])
            common = np.bincount(pair[order][1:][same], minlength=len(x))
            ok = 100 * common >= percent * (nx + ny - common)
            yield _batch(x=(x[ok], pa.int64()), y=(y[ok], pa.int64()))

    return run


def verified(pairs: DataFrame, texts: DataFrame, ngram: int, percent: int) -> DataFrame:
    """The pairs (x, y) of nodes whose true sets are similar enough."""
    y = texts.select(F.col("node").alias("y"), F.col("text").alias("text_y"))
    x = texts.select(F.col("node").alias("x"), F.col("text").alias("text_x"))
    return pairs.join(y, "y").join(x, "x").select("x", "y", "text_x", "text_y").mapInArrow(_verify(ngram, percent), "x long, y long")


def _could_link(na: Column, nb: Column, bits: Column, percent: int) -> Column:
    """Sizes and differing sketch bits of two nodes allow a link."""
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (bits * (100 + percent) <= (na + nb) * (100 - percent))


def _bits(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))


def _near(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches, "wide_x", "wide_y"):
            keep = np.ones(b.num_rows, bool)
            both = np.flatnonzero(np.asarray(b.column("wide_x").is_valid()) & np.asarray(b.column("wide_y").is_valid()))
            n_x, n_y = b.column("n_x").fill_null(0).to_numpy(), b.column("n_y").fill_null(0).to_numpy()
            for i in both:
                bits = differing_bits(b.column("wide_x")[i].as_py(), b.column("wide_y")[i].as_py())
                keep[i] = bits * (100 + percent) <= (n_x[i] + n_y[i]) * (100 - percent)
            yield _batch(x=(b.column("x").to_numpy()[keep], pa.int64()), y=(b.column("y").to_numpy()[keep], pa.int64()))

    return run


def widely_plausible(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that wide sketches, (node, n, wide) of large sets, don't rule out."""
    side = lambda k: wide.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("wide").alias(f"wide_{k}"))
    return pairs.join(side("y"), "y", "left").join(side("x"), "x", "left").mapInArrow(_near(percent), "x long, y long")


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that sizes and narrow sketches don't rule out."""
    sketch = [f"b{i}" for i in range(SKETCH_WORDS)]
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), *[F.col(c).alias(f"{k}_{c}") for c in sketch])
    j = pairs.join(side("x"), "x").join(side("y"), "y")
    return j.where(_could_link(F.col("n_x"), F.col("n_y"), _bits("x_b", "y_b"), percent)).select("x", "y")


def jaccard_components(docs: DataFrame, ngram: int = 3, percent: int = 90, subparts: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles (distinct), component_id (smallest doc_id that
    links reach), links long (verified links between its set and different ones).

    A link is 100 * intersection >= percent * union of the lower-cased word shingle sets.
    Components are exact, but for sets that agree in 128 bits of hashes; ``links`` counts the
    links that were verified to find them, which in groups of near copies are fewer than
    there are.

    Texts without words (or null) have an empty set and are linked with nothing.  Rows with a
    null doc_id have a null component and link nothing.  Repeated rows are copies: one set.
    Very long texts are taken whole.  An empty table gives an empty one; other columns are
    ignored.
    """
    return _components(columns(docs, "doc_id", "text"), ngram, percent, subparts).drop("root", "row_key", "row_sub")


def _row_keys(doc_id: str, text: str) -> dict[str, Column]:
    """96 bits that tell rows apart by doc_id and text."""
    return {"row_key": F.xxhash64(doc_id, text), "row_sub": F.hash(text, doc_id)}


#: Names of sets that may turn out to be shared by different sets; at 64 bits a table of
#: 10**11 sets has a few hundred.
MOST_CLASHES = 1 << 20


def _components(docs: DataFrame, ngram: int, percent: int, subparts: int) -> DataFrame:
    """The rows of ``jaccard_components`` with row_key, row_sub, and the root (a node) of each
    one's component, which unlike component_id no two components share, also where rows
    with different texts have one doc_id."""
    spark = prepare(docs.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = [F.first(f"b{i}").alias(f"b{i}") for i in range(SKETCH_WORDS)]

    def describe(clashes: np.ndarray) -> tuple[DataFrame, DataFrame]:
        sets = stored(d.withColumns(_row_keys("doc_id", "text")).mapInArrow(_describe(ngram, percent, clashes), _SETS), "shingle-sets")
        by_name = sets.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("name")
        return sets, stored(by_name.agg(F.min("second").alias("low"), F.max("second").alias("high"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), *sketch), "set-names")

    clashes = np.zeros(0, K.U64)
    sets, named = describe(clashes)
    clash = named.where("low <> high").select("name").limit(MOST_CLASHES + 1).collect()  # next to none
    if len(clash) > MOST_CLASHES:
        raise RuntimeError("names of sets clash far more often than hashes do")
    if clash:
        clashes = np.array([r["name"] for r in clash], np.int64).view(K.U64)
        sets, named = describe(clashes)
    sets = sets.withColumnRenamed("name", "node")
    nodes = named.withColumnRenamed("name", "node").drop("low", "high")
    large = sets.where("wide IS NOT NULL AND doc_id IS NOT NULL").groupBy("node")
    wide = stored(large.agg(F.first("n_shingles").alias("n"), F.first("wide").alias("wide")), "wide-sketches")
    signed = d.where("doc_id IS NOT NULL").mapInArrow(_sign(ngram, percent, subparts, clashes), "sig long, node long")
    shared = signed.repartition(n, "sig").sortWithinPartitions("sig", "node").mapInArrow(_shared, "sig long, node long")
    shared = stored(shared, "signatures")

    degree = shared.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))

    def linked_pairs(pairs: DataFrame, name: str) -> DataFrame:
        """The links among the pairs, of which there are few others: texts come with them only."""
        pairs = stored(pairs, f"{name}-tried")
        if pairs.isEmpty():
            return pairs
        asked = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
        asked = stored(asked.join(nodes, "node").select("node", "doc_id"), f"{name}-asked")
        # The row of the smallest id stands for a node; an equal id with another text is sorted
        # out, and of repeated rows one is kept.
        texts = d.join(asked, "doc_id").mapInArrow(_named(ngram, clashes), "node long, text string")
        texts = stored(texts.groupBy("node").agg(F.min("text").alias("text")), f"{name}-texts")
        return stored(verified(pairs, texts, ngram, percent), name)

    hubs = shared.join(degree, "node").groupBy("sig").agg(F.max(F.struct("degree", "node")).alias("m")).select("sig", F.col("m.node").alias("x"))
    stars = stored(shared.join(hubs, "sig").where("node <> x").select("x", F.col("node").alias("y")).distinct(), "star-pairs")
    links = linked_pairs(widely_plausible(plausible(stars, nodes, percent), wide, percent), "links")
    roots = connected_components(links)

    placed = shared.join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
    open_ = placed.groupBy("sig").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("sig")
    rest = stored(placed.join(open_, "sig").join(nodes.drop("doc_id"), "node"), "open-buckets")
    a, b = rest.alias("a"), rest.alias("b")
    apart = (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root"))
    tried = stars.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    pairs = a.join(b, (F.col("a.sig") == F.col("b.sig")) & apart & _could_link(F.col("a.n"), F.col("b.n"), _bits("a.b", "b.b"), percent)).select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct()
    more = linked_pairs(widely_plausible(pairs.join(tried, ["x", "y"], "left_anti"), wide, percent), "more-links")
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = connected_components(links)

    member = nodes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ends = links.select("x").unionByName(links.select(F.col("y").alias("x"))).groupBy(F.col("x").alias("node")).agg(F.count(F.lit(1)).alias("links"))
    found = member.join(least, "root").join(ends, "node", "left").select("node", "root", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    linked = F.col("n_shingles") > 0
    made = sets.select("doc_id", "row_key", "row_sub", "n_shingles", F.when(linked, F.col("node")).alias("node")).join(found, "node", "left")
    own = F.when(linked & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.when(~linked, F.col("doc_id")))
    return made.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"), "row_key", "row_sub", "root")


def keep_one_of_each(docs: DataFrame, ngram: int = 5, percent: int = 80, subparts: int = 2) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest doc_id.

    Rows without words or doc_id are in no group and stay.  All columns stay, whatever their
    names; of rows with equal doc_id and text any one does.  Groups may share their smallest
    doc_id: each keeps a row.  An empty table gives an empty one.
    """
    d, (doc_id, text) = numbered(docs, "doc_id", "text")
    groups = _components(columns(docs, "doc_id", "text"), ngram, percent, subparts)
    first = groups.where("n_shingles > 0 AND doc_id = component_id").groupBy("root").agg(F.min(F.struct("row_key", "row_sub")).alias("row"))
    single = F.col(doc_id).isNull() | ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = d.where(~single).withColumn("id", F.col(doc_id).cast("long")).withColumns(_row_keys("id", text))
    kept = keyed.join(first.select("row.*"), ["row_key", "row_sub"], "left_semi").dropDuplicates(["row_key", "row_sub"]).select(d.columns)
    return kept.unionByName(d.where(single)).toDF(*docs.columns)
