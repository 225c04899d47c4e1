"""Suffix-array deduplication of substrings of ``length`` bytes or more.

A byte goes if some ``length``-byte string that covers it starts anywhere else as well.
Sorting all suffixes of a corpus would move each byte many times over, so the suffix
array is sparse: it holds the suffixes that start at anchors. Anchors are local minima
of a rolling hash over ``SEED``-byte strings; a string of ``length`` bytes always holds
one, and equal strings hold the same. Every possible repeat therefore crosses equal
anchors, within a context of ``length`` - ``SEED`` bytes before and ``length`` bytes from
the anchor on.

1. One scan gives the anchors: hash of the seed string and of the context (128 bits).
2. Anchors whose seed is unique are dropped by counting. Where all contexts of a seed are
   equal, and where one context comes twice, all strings through it repeat. Only seeds
   with different contexts need a closer look, one example of each context.
3. Those contexts are sorted as an enhanced suffix array per seed. A stack scan over the
   common prefixes visits the interval tree; within an interval the occurrences are
   compared to the left, and those that share ``length`` bytes in all are repeats, given
   for every occurrence and not for neighbours alone.
4. A seed with more than ``GROUP`` different contexts is not gathered: its strings of
   ``length`` bytes are counted by digest, which partial aggregation shrinks. The strings
   that start in a stretch of ``STRETCH`` bytes share a core; where the core is unique
   none of them repeats, so most are never made.

Defined results: null and empty texts have 0 bytes and the digest of nothing; texts under
``length`` bytes stay whole; matches never cross texts; rows that share an id are told
apart by a digest of their text; equal rows are copies of each other and go; a null id is
an id of its own; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from oligo_engine.llm.common import Rolling, Scratch, checkpoint, list_column, map_arrow, release, slabs

LENGTH, SEED, GROUP, STRETCH = 400, 128, 256, 16


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Places that are the leftmost least value of some ``width`` values in a row."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    # the upper half decides, then the place: unlike values never tie by position alone
    keys = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    pad = np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([keys, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    kept = np.concatenate([[True], least[1:] != least[:-1]])
    return (least[kept] & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Anchors:
    """Anchors and context hashes of one text after another."""

    def __init__(self, length: int, seed: int):
        self.length, self.seed, self.before = length, seed, length - seed
        self.one, self.two = Rolling(31), Rolling(37)

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, seed hash, context hash) of the anchors of a text."""
        n = len(data)
        if n < self.length:
            none = np.zeros(0, np.uint64)
            return none.astype(np.int64), none, none
        one = self.one.prefix(data)
        starts = np.arange(n - self.seed + 1)
        seeds = self.one.span(one, starts, starts + self.seed)
        at = window_minima(seeds, self.before + 1)
        a, b = np.maximum(at - self.before, 0), np.minimum(at + self.length, n)
        shape = ((at - a) * 1024 + (b - at)).astype(np.uint64)
        return at, seeds[at], self.two.span(self.two.prefix(data), a, b) + shape


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and 96 bits (key, tag) that name a row, rows of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "text", F.xxhash64("doc_id", text).alias("key"), F.hash(text, "doc_id").alias("tag"))


def anchored(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """key, tag and the packed anchors of each text: at, seed, context."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, seed)
        for batch in batches:
            found = [
                anchors.find(data[a:b])
                for _, data, offsets in slabs(batch.column(2))
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())
            ]
            sizes = np.array([len(f[0]) for f in found], np.int64)
            columns = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in zip(*found)]
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    list_column(columns[0].astype(np.int32), sizes),
                    list_column(columns[1].view(np.int64), sizes),
                    list_column(columns[2].view(np.int64), sizes),
                ],
                ["key", "tag", "at", "seed", "context"],
            )

    schema = "key long, tag int, at array<int>, seed array<long>, context array<long>"
    return map_arrow(rows.select("key", "tag", "text"), find, schema)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def prefix_intervals(texts: list[bytes]) -> Iterator[tuple[int, list[int]]]:
    """(common prefix, members) of every interval of the enhanced suffix array.

    The array is ``texts`` in order with the common prefixes of neighbours; the stack
    holds the open intervals, and one closes where the prefix falls below its own.
    """
    order = sorted(range(len(texts)), key=texts.__getitem__)
    stack: list[tuple[int, int]] = []
    for k in range(1, len(order) + 1):
        depth = common(texts[order[k - 1]], texts[order[k]]) if k < len(order) else -1
        left = k - 1
        while stack and stack[-1][0] > depth:
            closed, left = stack.pop()
            yield closed, order[left:k]
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))


def left_extensions(members: list[int], lefts: list[bytes]) -> Iterator[tuple[int, int]]:
    """(member, longest left extension it shares with another member).

    ``lefts`` are the reversed texts before the occurrences; if all extensions are alike,
    the interval is no maximal repeat but is covered by a longer one.
    """
    order = sorted(members, key=lefts.__getitem__)
    shared = [common(lefts[a], lefts[b]) for a, b in zip(order, order[1:])]
    for i, member in enumerate(order):
        yield member, max(shared[i - 1] if i else 0, shared[i] if i < len(shared) else 0)


def shared_strings(befores: list[bytes], afters: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(member, least, most): strings of ``length`` bytes that start least .. most bytes
    before the member's anchor are found at another member's anchor too."""
    lefts = [b[::-1] for b in befores]
    reach = max(map(len, lefts), default=0)
    found = []
    for depth, members in prefix_intervals(afters):
        need = max(length - depth, 0)
        if need <= reach:
            found += [(m, need, left) for m, left in left_extensions(members, lefts) if left >= need]
    return found


def contexts_of(rows: DataFrame, wanted: DataFrame, length: int, seed: int) -> DataFrame:
    """seed, context, large, before, after: the bytes around the wanted examples."""
    reach = length - seed
    listed = wanted.groupBy("key", "tag").agg(F.collect_list(F.struct("at", "seed", "context", "large")).alias("_asked"))
    met = rows.join(listed, ["key", "tag"]).select("text", "_asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, asked in zip(*batch.columns):
                text, asked = (value.as_py() or "").encode(), asked.as_py()
                yield pa.record_batch(
                    [
                        pa.array([x["seed"] for x in asked], pa.int64()),
                        pa.array([x["context"] for x in asked], pa.int64()),
                        pa.array([x["large"] for x in asked], pa.bool_()),
                        pa.array([text[max(0, x["at"] - reach) : x["at"]] for x in asked], pa.binary()),
                        pa.array([text[x["at"] : x["at"] + length] for x in asked], pa.binary()),
                    ],
                    ["seed", "context", "large", "before", "after"],
                )

    return map_arrow(met, cut, "seed long, context long, large boolean, before binary, after binary")


FOUND = "seed long, context long, least int, most int"


def scanned(examples: DataFrame, length: int) -> DataFrame:
    """The suffix-array scan of every seed's contexts, seeds in order in their partition."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, bytes, bytes]] = []
        last = None

        def close() -> list[tuple[int, int, int, int]]:
            found = shared_strings([g[1] for g in group], [g[2] for g in group], length)
            return [(last, group[m][0], low, high) for m, low, high in found]

        def batch_of(rows):
            return pa.RecordBatch.from_pylist(
                [dict(zip(("seed", "context", "least", "most"), r)) for r in rows],
                pa.schema([("seed", pa.int64()), ("context", pa.int64()), ("least", pa.int32()), ("most", pa.int32())]),
            )

        for batch in batches:
            rows = []
            for seed, context, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                if seed != last:
                    rows += close()
                    group, last = [], seed
                group.append((context, before, after))
            yield batch_of(rows)
        yield batch_of(close())

    dealt = examples.select("seed", "context", "before", "after").repartition("seed").sortWithinPartitions("seed")
    return map_arrow(dealt, scan, FOUND)


def counted(examples: DataFrame, length: int, tables: Scratch) -> DataFrame:
    """The same by digests of all strings through a context, for seeds with many contexts."""

    def digest(text: bytes) -> bytes:
        return hashlib.blake2b(text, digest_size=16).digest()

    def batch_of(rows: list[tuple], last: str, kind: pa.DataType) -> pa.RecordBatch:
        seeds, contexts, places, values = zip(*rows) if rows else ((),) * 4
        return pa.record_batch(
            [pa.array(seeds, pa.int64()), pa.array(contexts, pa.int64()), pa.array(places, pa.int32()), pa.array(values, kind)],
            ["seed", "context", "place", last],
        )

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes that all strings share which start ``far`` .. ``far`` + STRETCH - 1
        bytes before the anchor; at a text's end they are what is left of them."""
        for batch in batches:
            rows = []
            for seed, context, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                text, at = before + after, len(before)
                for far in range(0, at + 1, STRETCH):
                    a, b = max(at - far, 0), at - far - STRETCH + 1 + length
                    rows.append((seed, context, far, digest(text[a : max(b, a)])))
            yield batch_of(rows, "core", pa.binary())

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for seed, context, before, after, places in zip(*(c.to_pylist() for c in batch.columns)):
                text, at = before + after, len(before)
                for far in places:
                    for p in range(max(at - far - STRETCH + 1, 0), min(at - far, len(text) - length) + 1):
                        rows.append((seed, context, at - p, digest(text[p : p + length])))
            yield batch_of(rows, "digest", pa.binary())

    cored = map_arrow(
        examples.select("seed", "context", "before", "after"), cores, "seed long, context long, place int, core binary"
    )
    alike = cored.groupBy("seed", "place", "core").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    open_ = cored.join(alike, ["seed", "place", "core"]).groupBy("seed", "context").agg(F.collect_set("place").alias("places"))
    asked = examples.join(open_, ["seed", "context"]).select("seed", "context", "before", "after", "places")
    made = tables.keep(map_arrow(asked, strings, "seed long, context long, place int, digest binary"))
    twice = made.groupBy("seed", "place", "digest").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    places = made.join(twice, ["seed", "place", "digest"]).groupBy("seed", "context").agg(
        F.array_sort(F.collect_set("place")).alias("p")
    )
    # runs of neighbouring places
    first = F.filter("p", lambda x, i: (i == 0) | (x - F.get("p", i - 1) > 1))
    last = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) - x > 1))
    return places.select("seed", "context", F.explode(F.arrays_zip(first.alias("least"), last.alias("most"))).alias("r")).select(
        "seed", "context", "r.least", "r.most"
    )


def repeated_spans(rows: DataFrame, length: int, seed: int, group: int) -> DataFrame:
    """key, tag, spans: byte ranges covered by repeated strings, not merged, each packed
    as start * 2**32 + end; an end may pass the end of the text."""
    spark = rows.sparkSession
    with Scratch(spark) as tables:
        packed = tables.keep(anchored(rows, length, seed))
        every = packed.select("key", "tag", F.explode(F.arrays_zip("at", "seed", "context")).alias("x")).select("key", "tag", "x.*")
        seeds = (
            every.groupBy("seed")
            .agg(F.count("*").alias("_n"), F.min("context").alias("_low"), F.max("context").alias("_high"))
            .filter("_n > 1")
            .select("seed", (F.col("_low") != F.col("_high")).alias("mixed"))
        )
        met = tables.keep(every.join(seeds, "seed"))
        del packed, every, seeds
        release(spark)
        contexts = (
            met.filter("mixed")
            .groupBy("seed", "context")
            .agg(F.count("*").alias("n"), F.min(F.struct("key", "tag", "at")).alias("_one"))
        )
        contexts = tables.keep(contexts.select("seed", "context", "n", "_one.*"))
        sizes = contexts.groupBy("seed").agg((F.count("*") > group).alias("large"), F.min("n").alias("_least"))
        wanted = contexts.join(sizes.filter("_least = 1"), "seed")
        examples = tables.keep(contexts_of(rows, wanted, length, seed))
        del sizes, wanted
        release(spark)
        found = scanned(examples.filter("NOT large"), length).unionByName(counted(examples.filter("large"), length, tables))
        reach = length - seed
        alike = contexts.filter("n > 1").select("seed", "context", F.lit(0).alias("least"), F.lit(reach).alias("most"))
        verdicts = tables.keep(found.unionByName(alike))
        del examples, found, contexts, alike
        release(spark)
        through = met.filter("mixed").join(verdicts, ["seed", "context"]).select("key", "tag", "at", "least", "most")
        whole = met.filter("NOT mixed").select("key", "tag", "at", F.lit(0).alias("least"), F.lit(reach).alias("most"))
        start = F.greatest(F.col("at") - F.col("most"), F.lit(0)).cast("long")
        end = (F.col("at") - F.col("least") + length).cast("long")
        spans = (
            through.unionByName(whole)
            .select("key", "tag", (F.shiftleft(start, 32) + end).alias("span"))
            .groupBy("key", "tag")
            .agg(F.collect_list("span").alias("spans"))
        )
        return checkpoint(spans)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup_suffixes(docs: DataFrame, length: int = LENGTH, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every row."""
    rows = keyed(docs)
    spans = repeated_spans(rows, length, seed, group)
    met = rows.join(spans, ["key", "tag"], "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, kept, gone = [], [], [], [], []
            for value, spans in zip(batch.column(1), batch.column(2)):
                text = (value.as_py() or "").encode()
                found = merged([(s >> 32, min(s & 0xFFFFFFFF, len(text))) for s in spans.as_py() or []])
                digest, last = hashlib.sha256(), 0
                for a, b in found:
                    digest.update(text[last:a])
                    last = b
                digest.update(text[last:])
                sizes.append(len(text))
                removed.append(sum(b - a for a, b in found))
                runs.append(len(found))
                kept.append(digest.hexdigest())
                gone.append([{"start": a, "end": b} for a, b in found])
            longs = pa.int64()
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, longs), pa.array(removed, longs), pa.array(runs, longs), pa.array(kept, pa.string()), pa.array(gone, pa.list_(pa.struct([("start", longs), ("end", longs)])))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        met,
        cut,
        f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>",
    )
