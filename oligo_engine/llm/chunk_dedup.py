"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text and cuts where its top bits are zero, so cuts
depend on the last 32 bytes alone and find their places again after an insertion. Equal
chunks are found by a 128-bit digest; the first occurrence (smallest id, then place)
stays. A chunk met again is a seed only: seeds in a row with the same first occurrence make
a run, and both ends of a run are compared with the bytes around that occurrence, further
and further until they differ or a text ends. What touches is put together, and goes where
it is at least ``min_bytes`` long, which leaves short accidental repeats alone.

Hot chunks: occurrences are counted by partial aggregation, and the join that brings the
first occurrence back is one Spark can split, so a passage shared by a third of all
documents meets no single task.

Defined results: null stays null and counts as empty; cuts fall between characters, so
what is left is UTF-8; rows of one id are told apart by digests of their text and come in
the order of these; of rows equal in id and text one stays as if alone and the others are
copies of it; a null id comes last in order; an empty table gives an empty result; names
of further columns may not start with an underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from oligo_engine.llm.common import Scratch, checkpoint, map_arrow, release, slabs
from oligo_engine.llm.suffix_dedup import common

#: Chunk length in bytes: no cut below the first, a forced one at the third.
MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 20, 5, 512
MIN_BYTES = 96
#: Bytes compared at the end of a run at first; eight times as many each time all are equal.
REACH = 128


def gear_table() -> np.ndarray:
    return np.random.default_rng(2024).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h = 2 h + gear[byte] modulo 2**32 at every byte: the last 32 bytes count.

    Doubling: the hash of the last 2m bytes is that of the last m plus, shifted by m,
    that of the m before.
    """
    h = gear_table()[data]
    for m in (1, 2, 4, 8, 16):
        grown = h.copy()
        grown[m:] += h[:-m] << np.uint32(m)
        h = grown
    return h


def cuts(text: np.ndarray) -> list[int]:
    """Ends of the chunks of one text, its length last."""
    n = len(text)
    if not n:
        return []
    marked = gear_hashes(text) < np.uint32(1 << (32 - MEAN_BITS))
    marked[:-1] &= (text[1:] & 0xC0) != 0x80  # never inside a character
    out, last = [], 0
    for end in (np.flatnonzero(marked) + 1).tolist() + [n]:
        while end - last > MAX_CHUNK:
            forced = last + MAX_CHUNK
            while forced > last + 1 and forced < n and text[forced] & 0xC0 == 0x80:
                forced -= 1
            out.append(forced)
            last = forced
        if end - last >= MIN_CHUNK or end == n > last:
            out.append(end)
            last = end
    return out


def chunk_column(column: pa.Array) -> Iterator[tuple[bytes, list[int]]]:
    for _, data, offsets in slabs(column):
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            yield data[a:b].tobytes(), cuts(data[a:b])


def told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` with 96 bits (_key, _tag) that name id and text, and _again at all but one
    of the rows equal in both.

    The one is the least by a number that is written down before it is compared, so no
    group of equal rows meets one task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.withColumns({"_key": F.xxhash64("doc_id", text), "_tag": F.hash(text, "doc_id")})
    name = ["_key", "_tag"]
    twice = named.filter(F.octet_length(text) > 0).groupBy(*name).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    if twice.isEmpty():
        return named.withColumn("_again", F.lit(False))
    twice = checkpoint(twice)
    equal = checkpoint(named.join(twice, name, "left_semi").withColumn("_nth", F.monotonically_increasing_id()))
    least = equal.groupBy(*name).agg(F.min("_nth").alias("_nth")).withColumn("_one", F.lit(True))
    told = equal.join(least, [*name, "_nth"], "left").withColumn("_again", F.col("_one").isNull())
    alone = named.join(twice, name, "left_anti").withColumn("_again", F.lit(False))
    return alone.unionByName(told.select(*alone.columns))


def chunked(rows: DataFrame) -> DataFrame:
    """key, tag, doc_id, start, end, digest and its first 64 bits (head) of every chunk;
    rows that come again have none."""

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends, digests = [], [], [], []
            for i, (text, stops) in enumerate(chunk_column(batch.column(3))):
                a = 0
                for b in stops:
                    digests.append(hashlib.blake2b(text[a:b], digest_size=16).digest())
                    starts.append(a)
                    ends.append(b)
                    a = b
                rows += [i] * len(stops)
            taken = pa.array(rows, pa.int64())
            yield pa.record_batch(
                [
                    *[batch.column(c).take(taken) for c in range(3)],
                    pa.array(starts, pa.int32()),
                    pa.array(ends, pa.int32()),
                    pa.array(digests, pa.binary()),
                    pa.array(np.frombuffer(b"".join(digests), "<i8")[::2]),
                ],
                ["key", "tag", "doc_id", "start", "end", "digest", "head"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    once = rows.filter("NOT _again").select("_key", "_tag", "doc_id", "text")
    return map_arrow(once, chunk, f"key long, tag int, doc_id {kind}, start int, end int, digest binary, head long")


def repeated(chunks: DataFrame, tables: Scratch) -> DataFrame:
    """key, tag, start, end of the chunks that are not the first of their digest, and the
    place of that: first_key, first_tag, first_at.

    Most chunks stand alone. Counts of 64 bits of the digest name those that may not, and
    only their rows are kept and compared by the whole digest.
    """
    heads = tables.keep(chunks.groupBy("head").agg(F.count("*").alias("_n")).filter("_n > 1").select("head"))
    release(chunks.sparkSession)
    met = tables.keep(chunks.join(heads, "head", "left_semi").drop("head"))
    release(chunks.sparkSession)
    place = F.struct(
        F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), "key", "tag", F.col("start").alias("at")
    )
    firsts = met.groupBy("digest").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    again = met.join(firsts.drop("_n"), "digest").filter(~place.eqNullSafe(F.col("_first")))
    return again.select("key", "tag", "start", "end", *[F.col(f"_first.{c}").alias(f"first_{c}") for c in ("key", "tag", "at")])


RUNS = "key long, tag int, start int, end int, first_key long, first_tag int, first_at int"


def runs_of(chunks: DataFrame, tables: Scratch) -> DataFrame:
    """Repeated chunks that follow each other here and at their first occurrence, as one."""

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = []
            for key, tag, seeds in zip(*(c.to_pylist() for c in batch.columns)):
                last = None
                for x in seeds:
                    source = (x["first_key"], x["first_tag"], x["first_at"] - x["start"])
                    if source == last and out[-1][3] == x["start"]:
                        out[-1][3] = x["end"]
                    else:
                        out.append([key, tag, x["start"], x["end"], x["first_key"], x["first_tag"], x["first_at"]])
                    last = source
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            columns = zip(*out) if out else ((),) * 7
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in RUNS.split(", ")])

    seeds = F.array_sort(F.collect_list(F.struct("start", "end", "first_key", "first_tag", "first_at")))
    return map_arrow(repeated(chunks, tables).groupBy("key", "tag").agg(seeds.alias("seeds")), join_up, RUNS)


def bytes_beside(rows: DataFrame, asked: DataFrame, reach: int) -> DataFrame:
    """``asked`` (key, tag, ahead, at and others) with up to ``reach`` bytes of the row's
    text from ``at`` on, or those before it in reverse."""
    others = [c for c in asked.columns if c not in ("key", "tag")]
    listed = asked.groupBy(F.col("key").alias("_key"), F.col("tag").alias("_tag")).agg(
        F.collect_list(F.struct(*others)).alias("_asked")
    )
    texts = rows.filter("NOT _again").select("_key", "_tag", "text")
    schema = T.StructType([*asked.select("key", "tag", *others).schema.fields, T.StructField("beside", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(2), batch.column(3)
            beside = []
            for value, asked in zip(texts, lists):
                text = (value.as_py() or "").encode()
                for x in asked.as_py():
                    at = x["at"]
                    beside.append(text[at : at + reach] if x["ahead"] else text[max(at - reach, 0) : at][::-1])
            parent = pc.list_parent_indices(lists)
            flat = lists.flatten()
            yield pa.record_batch(
                [batch.column(0).take(parent), batch.column(1).take(parent), *[flat.field(c) for c in others], pa.array(beside, pa.binary())],
                ["key", "tag", *others, "beside"],
            )

    return map_arrow(texts.join(listed, ["_key", "_tag"]).select("_key", "_tag", "text", "_asked"), cut, schema)


def extensions(rows: DataFrame, runs: DataFrame, tables: Scratch, reach: int = REACH) -> DataFrame:
    """key, tag, start, end of the bytes beyond the ends of runs that are also found
    beyond the ends of their first occurrences."""
    own = ["key", "tag", "ahead", "at", "first_key", "first_tag", "first_at"]
    size = F.col("end") - F.col("start")
    before = runs.select("key", "tag", F.lit(False).alias("ahead"), F.col("start").alias("at"), "first_key", "first_tag", "first_at")
    after = runs.select(
        "key", "tag", F.lit(True).alias("ahead"), F.col("end").alias("at"), "first_key", "first_tag", (F.col("first_at") + size).alias("first_at")
    )
    ends = before.filter("at > 0 AND first_at > 0").unionByName(after)
    found = None
    while True:
        places = ends.select(F.col("first_key").alias("key"), F.col("first_tag").alias("tag"), "ahead", F.col("first_at").alias("at"))
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("first_key", "long"), ("first_tag", "int"), ("first_at", "int"))]
        asked = ends.select(*own).unionByName(places.distinct().select("key", "tag", "ahead", "at", *nothing))
        beside = tables.keep(bytes_beside(rows, asked, reach))
        release(rows.sparkSession)
        firsts = beside.filter("first_key IS NULL").select(
            F.col("key").alias("first_key"), F.col("tag").alias("first_tag"), "ahead", F.col("at").alias("first_at"), F.col("beside").alias("first_beside")
        )
        met = beside.filter("first_key IS NOT NULL").join(firsts, ["first_key", "first_tag", "ahead", "first_at"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = zip(*(c.to_pylist() for c in batch.columns[len(own) :]))
                yield pa.record_batch([*batch.columns[: len(own)], pa.array([common(a, b) for a, b in pairs], pa.int32())], [*own, "n"])

        schema = T.StructType([*ends.select(*own).schema.fields, T.StructField("n", T.IntegerType())])
        grown = tables.keep(map_arrow(met.select(*own, "beside", "first_beside"), compare, schema).filter("n > 0"))
        release(rows.sparkSession)
        spans = grown.select(
            "key",
            "tag",
            F.when(F.col("ahead"), F.col("at")).otherwise(F.col("at") - F.col("n")).alias("start"),
            F.when(F.col("ahead"), F.col("at") + F.col("n")).otherwise(F.col("at")).alias("end"),
        )
        found = spans if found is None else found.unionByName(spans)
        step = F.when(F.col("ahead"), F.col("n")).otherwise(-F.col("n"))
        ends = grown.filter(F.col("n") == reach).withColumns({"at": F.col("at") + step, "first_at": F.col("first_at") + step}).select(*own)
        if ends.isEmpty():
            return found
        reach *= 8


def spans_left(data: bytes, gone: list[tuple[int, int]], min_bytes: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes, cut back to whole characters, that are long enough."""
    runs: list[list[int]] = []
    for a, b in sorted(gone):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    for run in runs:
        while run[0] < len(data) and data[run[0]] & 0xC0 == 0x80:
            run[0] += 1
        while run[1] < len(data) and data[run[1]] & 0xC0 == 0x80:
            run[1] -= 1
    return [(a, b) for a, b in runs if b > a and b - a >= min_bytes]


def dedup_substrings(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """All columns of ``docs`` with ``text`` shortened, and n_bytes, n_removed, n_spans, in
    place of any of ``docs`` that have these names.

    Marks are gathered by row, so they are as many as its chunks at most; a row equal to
    another in id and text goes whole where it is long enough.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans")
    rows = told_apart(docs)
    with Scratch(docs.sparkSession) as tables:
        runs = tables.keep(runs_of(chunked(rows), tables))
        release(docs.sparkSession)
        spans = runs.select("key", "tag", "start", "end").unionByName(extensions(rows, runs, tables))
        marks = checkpoint(
            spans.groupBy(F.col("key").alias("_key"), F.col("tag").alias("_tag")).agg(
                F.collect_list(F.struct("start", "end")).alias("_gone")
            )
        )
    release(docs.sparkSession)
    own = docs.columns
    met = rows.join(marks, ["_key", "_tag"], "left").select(*own, "_gone", "_again")
    kinds = docs.schema

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = own.index("text")
        for batch in batches:
            texts, sizes, removed, spans = [], [], [], []
            for value, gone, again in zip(batch.column(at), batch.column(len(own)), batch.column(len(own) + 1)):
                text = value.as_py()
                data = (text or "").encode()
                places = [(0, len(data))] if again.as_py() else [(g["start"], g["end"]) for g in gone.as_py() or []]
                found = spans_left(data, places, min_bytes)
                kept, last = [], 0
                for a, b in found:
                    kept.append(data[last:a])
                    last = b
                kept.append(data[last:])
                texts.append(None if text is None else b"".join(kept).decode())
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in found))
                spans.append(len(found))
            columns = [batch.column(i) if i != at else pa.array(texts, pa.string()) for i in range(len(own))]
            yield pa.record_batch(
                [*columns, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
                [*own, "n_bytes", "n_removed", "n_spans"],
            )

    schema = T.StructType(
        [*kinds.fields, *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]]
    )
    return map_arrow(met, cut_out, schema)
