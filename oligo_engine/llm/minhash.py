"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

Two permutations serve all coordinates: the first shuffles the universe of 32-bit
shingle codes, the second is shifted circularly by k for coordinate k, and the
coordinate is the least value over the document's set. Both are bijections of 0 .. 2**32
- 1, so the shift is a subtraction modulo 2**32. Bands of coordinates give candidate
buckets; a link is confirmed on the full sets of 64-bit shingle hashes.

Groups of any size: documents with equal sets are one node from the start; a bucket
emits pairs with its smallest id alone (linear in its size), and only members whose
component that leaves apart from the smallest id's are compared with the rest of the
bucket. Every pair is first held against a bound that is exact: bitmaps of the two sets
differ in no more bits than the sets differ in shingles, so a pair whose bitmaps are too
far apart cannot be a link and is never emitted. At rows=6, bands=40 a pair of similarity 0.8 shares no bucket with a chance of
5e-6, and the chance falls steeply above.

Defined results: a text without words, or null, has an empty set, links with nothing and
is kept; fewer words than a shingle are one shingle, the whole sequence; a null id links
with nothing and is kept; rows with one id are one document of the graph; repeated rows
are copies. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from oligo_engine.llm.common import Rolling, checkpoint, list_column, map_arrow, mix64, slabs

ROWS, BANDS = 6, 40
#: 64-bit words of a set's bitmap.
BITMAP = 32
SPACES = [9, 10, 11, 12, 13, 32]


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle of a slab, documents in order."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = np.zeros(256, bool)
    space[SPACES] = True
    gap = space[data]
    edge = np.ones(len(data) + 1, bool)  # a word may start or end here
    edge[1:-1] = gap[:-1]
    edge[offsets[offsets < len(data)]] = True
    starts = np.flatnonzero(edge[:-1] & ~gap)
    edge[1:-1] = gap[1:]
    edge[0] = edge[-1] = True
    edge[offsets[offsets < len(data)]] = True
    ends = np.flatnonzero(edge[1:] & ~gap) + 1
    hashes = rolling.span(rolling.prefix(lower_ascii()[data]), starts, ends)
    doc = np.searchsorted(offsets, starts, "right") - 1
    counts = np.bincount(doc, minlength=n)
    out = np.full(len(hashes), 0x9E3779B97F4A7C15, np.uint64)
    length = np.minimum(np.repeat(counts, counts), words)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    for k in range(words):
        take = np.minimum(np.arange(len(hashes)) + k, len(hashes) - 1)
        grown = mix64(out * np.uint64(0xD6E8FEB86659FD93) + hashes[take] + np.uint64(k))
        out = np.where(k < length, grown, out)
    place = np.arange(len(hashes)) - first
    whole = place <= np.maximum(np.repeat(counts, counts) - words, 0)
    return doc[whole], out[whole]


def distinct_sets(column: pa.Array, words: int, rolling: Rolling) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for _, data, offsets in slabs(column):
        doc, hashes = shingle_hashes(data, offsets, words, rolling)
        cuts = np.searchsorted(doc, np.arange(len(offsets)))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield np.unique(hashes[a:b])


def permuted(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the unsigned 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: least second-permutation value at every circular shift."""
    codes = permuted((hashes >> np.uint64(32)).astype(np.uint32))
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    step = max(1, (1 << 16) // coordinates)  # stays in the processor's cache
    for i in range(0, len(codes), step):
        np.minimum(out, permuted(codes[None, i : i + step] - shifts).min(axis=1), out=out)
    return out


def band_keys(signed: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signed.reshape(bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for r in range(rows):
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, r])
    return key


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bit for every shingle, at a place that its hash names."""
    bits = np.zeros(64 * BITMAP, np.uint8)
    bits[(hashes % np.uint64(64 * BITMAP)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def can_link(a: str, b: str, percent: int) -> Column:
    """False only where sizes (n) or bitmaps (bits) prove the similarity to be lower.

    With sets that differ in d shingles, similarity p / 100 means (m + n - d) / (m + n + d)
    >= p / 100, so d (100 + p) <= (m + n) (100 - p); d is at least the bits that differ.
    """
    m, n = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = reduce(
        lambda x, y: x + y,
        [F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(BITMAP)],
    )
    return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & (differ * (100 + percent) <= (m + n) * (100 - percent))


def signed_documents(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (k1, k2), its bitmap and the band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(11)
        for batch in batches:
            sizes, k1, k2, keys, bits = [], [], [], [], []
            for found in distinct_sets(batch.column(1), words, rolling):
                sizes.append(len(found))
                k1.append(int(np.bitwise_xor.reduce(mix64(found))) if len(found) else 0)
                k2.append(int(np.sum(found * (found | np.uint64(1)), dtype=np.uint64)))
                bits.append(bitmap(found))
                keys.append(band_keys(signature(found, bands * rows), bands, rows) if len(found) else np.zeros(0, np.uint64))
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(k1, np.uint64).view(np.int64)),
                    pa.array(np.array(k2, np.uint64).view(np.int64)),
                    list_column(np.concatenate(bits or [np.zeros(0, np.int64)]), np.full(len(bits), BITMAP)),
                    list_column(np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64), np.array([len(k) for k in keys])),
                ],
                ["doc_id", "n_shingles", "k1", "k2", "bits", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", "text"),
        sign,
        f"doc_id {kind}, n_shingles long, k1 long, k2 long, bits array<long>, keys array<long>",
    )


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, full shingle set of the documents named in ``ids``."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(11)
        for batch in batches:
            found = list(distinct_sets(batch.column(1), words, rolling))
            yield pa.record_batch(
                [batch.column(0), list_column(np.concatenate(found).view(np.int64), np.array([len(s) for s in found]))]
                if found
                else [batch.column(0), pa.array([], pa.list_(pa.int64()))],
                ["id", "shingles"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    return map_arrow(wanted, shingle, f"id {kind}, shingles array<long>")


def confirmed(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = sets_of(docs, ids, words)
    both = (
        pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("_b")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("_a")), "a")
        .select("a", "b", F.size("_a").alias("_m"), F.size("_b").alias("_n"), F.size(F.array_intersect("_a", "_b")).alias("_common"))
    )
    return both.filter(100 * F.col("_common") >= percent * (F.col("_m") + F.col("_n") - F.col("_common"))).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest reachable node, for nodes of ``edges`` (a, b).

    Alternating large-star and small-star steps; every step is two shuffles of the
    edges and halves the depth, so long chains take few rounds.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        around = pairs if not large else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("a", "_m"))
        met = around.join(least, "a")
        if large:
            out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        else:
            out = met.select(F.explode(F.array("a", "b")).alias("a"), F.col("_m").alias("b"))
        return out.filter(F.col("a") != F.col("b")).distinct()

    def print_of(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    # larger node first
    now = checkpoint(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    )
    seen = print_of(now)
    while seen[0]:
        now = checkpoint(star(star(now, True), False))
        latest = print_of(now)
        if latest == seen:
            break
        seen = latest
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def linked_components(
    docs: DataFrame, signed: DataFrame, words: int, percent: int
) -> DataFrame:
    """(node, component) over representatives of equal sets."""
    nodes = (
        signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        .groupBy("k1", "k2", "n_shingles")
        .agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
        .select("id", F.col("n_shingles").alias("n"), "bits", "keys")
    )
    placed = nodes.select(F.explode("keys").alias("bucket"), "id")
    shared = placed.groupBy("bucket").agg(F.min("id").alias("rep"), F.count("*").alias("_size")).filter("_size > 1")
    members = checkpoint(placed.join(shared, "bucket").select("bucket", "id", "rep"))
    sketches = nodes.select("id", "n", "bits").join(members.select("id").distinct(), "id", "left_semi")
    sketches = checkpoint(sketches)

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that no bound excludes."""
        x, y = sketches.alias("x"), sketches.alias("y")
        named = pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id"))
        return named.filter(can_link("x", "y", percent)).select("a", "b")

    met = members.filter(F.col("id") != F.col("rep")).select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    edges = checkpoint(confirmed(docs, possible(met), words, percent))
    found = components(edges)

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs of two components."""
        a = found.select(F.col("node").alias("a"), F.col("component").alias("_ca"))
        b = found.select(F.col("node").alias("b"), F.col("component").alias("_cb"))
        named = pairs.join(a, "a", "left").join(b, "b", "left")
        return named.filter(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b")

    left = apart(met)
    again = checkpoint(members.join(left.select(F.col("a").alias("rep"), F.col("b").alias("id")), ["rep", "id"], "left_semi"))

    def described(rows: DataFrame) -> DataFrame:
        """With sketch and component."""
        known = found.select(F.col("node").alias("id"), "component")
        return rows.join(sketches, "id").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))

    own = described(again.select("bucket", "id")).alias("l")
    others = described(
        members.filter(F.col("id") != F.col("rep"))
        .join(again.select("bucket").distinct(), "bucket", "left_semi")
        .join(again.select("bucket", "id", F.lit(True).alias("left")), ["bucket", "id"], "left")
    ).alias("m")
    # pairs of one component need no link; where both are left, one order is enough
    open_pair = (F.col("l.component") != F.col("m.component")) & (F.col("m.left").isNull() | (F.col("l.id") < F.col("m.id")))
    rest = (
        own.join(others, (F.col("l.bucket") == F.col("m.bucket")) & open_pair & can_link("l", "m", percent))
        .select(F.least("l.id", "m.id").alias("a"), F.greatest("l.id", "m.id").alias("b"))
        .distinct()
        .join(met, ["a", "b"], "left_anti")
    )
    more = checkpoint(rest)
    if not more.isEmpty():
        found = components(edges.unionByName(confirmed(docs, more, words, percent)))
    return found


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    signed = checkpoint(signed_documents(docs, words, bands, rows))
    found = linked_components(docs, signed, words, percent)
    has = F.col("n_shingles") > 0
    groups = (
        signed.filter(has & F.col("doc_id").isNotNull())
        .groupBy("k1", "k2", "n_shingles")
        .agg(F.min("doc_id").alias("node"))
        .join(found, "node", "left")
        .select("k1", "k2", F.col("n_shingles").alias("_n"), F.coalesce("component", "node").alias("component"))
    )
    same = (signed.k1 == groups.k1) & (signed.k2 == groups.k2) & (signed.n_shingles == groups._n) & has
    component = F.when(signed.doc_id.isNotNull(), F.coalesce(groups.component, signed.doc_id))
    return (
        signed.join(groups, same, "left")
        .select(signed.doc_id, signed.n_shingles, component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
