"""Near-duplicate documents by SimHash fingerprints and a byte-position inverted index.

A fingerprint is eight bytes. Two that differ in at most ``bits`` bits differ in at most
that many bytes, so they share at least 8 - bits bytes at their own positions: the
guaranteed minimum. The index lists fingerprints under (positions, their bytes). Single
bytes would make lists of a 256th of the corpus, so a list joins several positions,
chosen such that every set of minimum size holds one of them (``covering``); no pair is
lost. Within a list every pair's shared positional bytes are tallied, and a pair stays if
the tally reaches the minimum; what remains is verified bit by bit. Both tests are the
condition of the join, so pairs that fail are never rows.

Groups of any size: documents with one fingerprint are one node from the start, however
many copies there are. Lists of more than ``hot`` different fingerprints are dealt anew
under all finer position sets that hold theirs, up to the minimum, where a pair must meet.
The join of a list with itself is one that Spark can split.

Defined results: a null text, an empty one and one without words have the fingerprint
zero, linked like any other; fewer words than a shingle are one shingle, the whole
sequence; a null id keeps its fingerprint, links with nothing and has a null component;
rows that repeat an id are one document of the graph and come out each; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from oligo_engine.llm.common import Scratch, checkpoint, map_arrow
from oligo_engine.llm.minhash import components

SEED = 42
BYTES = 8
#: Positions of a list, and fingerprints of a list that is not dealt anew.
POSITIONS, HOT = 3, 2_000
#: Shingles hashed at a time: some MB for a text of any length.
STEP = 1 << 15


def shingle_codes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of one text, repeats included, some at a time."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()  # both know ASCII only: A-Z, and \x20 \x09-\x0D
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    for i in range(0, len(starts), STEP):
        pairs = zip(starts[i : i + STEP].tolist(), ends[i : i + STEP].tolist())
        yield np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in pairs), np.uint64)


def fingerprint(text: bytes, words: int) -> int:
    """A bit is 1 where over half of the shingle codes have it; 0 without words."""
    n, ones = 0, np.zeros(64, np.int64)
    for codes in shingle_codes(text, words):
        n += len(codes)
        bits = np.unpackbits(codes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, code (the fingerprint as a signed number) of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint((t.as_py() or "").encode(), words) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "code"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), sign, f"doc_id {kind}, code long")


def covering(size: int, least: int, within: tuple[int, ...] = ()) -> list[tuple[int, ...]]:
    """Sets of ``size`` positions that hold ``within``, such that every set of ``least``
    positions that holds it contains one of them; greedily few."""
    targets = {t for t in combinations(range(BYTES), least) if set(within) <= set(t)}
    choices = [c for c in combinations(range(BYTES), size) if set(within) <= set(c)]
    chosen = []
    while targets:
        best = max(choices, key=lambda c: sum(set(c) <= set(t) for t in targets))
        chosen.append(best)
        targets = {t for t in targets if not set(best) <= set(t)}
    return chosen


def listed(code: Column, positions: tuple[int, ...]) -> Column:
    """The list of a code: the position set, and the code's bytes at it."""
    mask = sum(0xFF << (8 * p) for p in positions)
    signed = mask - (1 << 64) if mask >> 63 else mask
    return F.struct(F.lit(sum(1 << p for p in positions)).alias("at"), code.bitwiseAND(F.lit(signed)).alias("bytes"))


def shared_bytes(x: Column, y: Column) -> Column:
    """How many of the eight positional bytes are the same."""
    differ = x.bitwiseXOR(y)
    low = F.lit(0x0101010101010101)
    folded = differ.bitwiseOR(F.shiftrightunsigned(differ, 4).bitwiseAND(F.lit(0x0F0F0F0F0F0F0F0F)))
    folded = folded.bitwiseOR(F.shiftrightunsigned(folded, 2).bitwiseAND(F.lit(0x3F3F3F3F3F3F3F3F)))
    folded = folded.bitwiseOR(F.shiftrightunsigned(folded, 1).bitwiseAND(F.lit(0x7F7F7F7F7F7F7F7F)))
    return F.lit(BYTES) - F.bit_count(folded.bitwiseAND(low))


def postings(codes: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """list (at, bytes), code: every code under each of the position sets."""
    return codes.select(F.explode(F.array(*[listed(F.col("code"), s) for s in sets])).alias("list"), "code").select(
        "list.at", "list.bytes", "code"
    )


def met(index: DataFrame, bits: int) -> DataFrame:
    """Pairs (a, b) of a list that share enough positional bytes and differ in few bits."""
    x, y = index.alias("x"), index.alias("y")
    a, b = F.col("x.code"), F.col("y.code")
    near = (a < b) & (shared_bytes(a, b) >= BYTES - bits) & (F.bit_count(a.bitwiseXOR(b)) <= bits)
    one_list = (F.col("x.at") == F.col("y.at")) & (F.col("x.bytes") == F.col("y.bytes"))
    return x.join(y, one_list & near).select(a.alias("a"), b.alias("b"))


def links(codes: DataFrame, bits: int = 3, size: int = POSITIONS, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: all pairs of different codes that differ in at most ``bits`` bits.

    ``codes`` has each code once. A pair can stand more than once.
    """
    least = BYTES - bits
    size = min(size, least)
    sets = covering(size, least)
    with Scratch(codes.sparkSession) as tables:
        index = tables.keep(postings(codes, sets))
        lengths = tables.keep(index.groupBy("at", "bytes").agg(F.count("*").alias("n")).filter("n > 1"))
        usual = index.join(lengths.filter(F.col("n") <= hot).select("at", "bytes"), ["at", "bytes"], "left_semi")
        found = met(usual, bits)
        full = lengths.filter(F.col("n") > hot).select("at", "bytes")
        if size < least and not full.isEmpty():
            members = index.join(full, ["at", "bytes"], "left_semi")
            for own in sets:
                finer = covering(least, least, own)
                again = members.filter(F.col("at") == sum(1 << p for p in own)).select("code")
                found = found.unionByName(met(postings(again, finer), bits))
        elif size == least:
            found = met(index.join(lengths.select("at", "bytes"), ["at", "bytes"], "left_semi"), bits)
        return checkpoint(found)


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs``."""
    with Scratch(docs.sparkSession) as tables:
        signed = tables.keep(fingerprints(docs, words))
        nodes = tables.keep(
            signed.filter(F.col("doc_id").isNotNull()).groupBy("code").agg(F.min("doc_id").alias("first"))
        )
        # rows that repeat an id join the codes of its texts
        ids = signed.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("code").alias("a"), F.max("code").alias("_last"))
        same_id = ids.filter(F.col("a") < F.col("_last")).join(signed, "doc_id").select("a", F.col("code").alias("b")).filter("a < b")
        edges = links(nodes.select("code"), bits).unionByName(same_id)
        classes = components(edges)
        met_by = F.col("code") == F.col("node")
        named = tables.keep(nodes.join(classes, met_by, "left").select("code", "first", F.coalesce("component", "code").alias("class")))
        least = named.groupBy("class").agg(F.min("first").alias("component_id"))
        of_code = tables.keep(named.join(least, "class").select(F.col("code").alias("_code"), "component_id"))
        shown = F.lower(F.lpad(F.hex("code"), 16, "0"))
        out = signed.join(of_code, (F.col("code") == F.col("_code")) & F.col("doc_id").isNotNull(), "left").select(
            "doc_id", shown.alias("fingerprint"), "component_id"
        )
        return checkpoint(out)
