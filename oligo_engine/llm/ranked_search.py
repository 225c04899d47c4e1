"""Ranked lexical search with pair-bound MaxScore.

Scores add up, over an item's terms, the term's weight times a saturated term frequency;
the formula is in integers, so equal scores are equal everywhere. ``k`` best documents
come out for every item, ties by smaller id, and all documents take part.

*Index.* One scan keeps of each document its length and the frequencies of the terms that
the items ask for. From these, shards of consecutive documents are built where the rows
stand: for every term the list of its documents with their impacts and the largest one;
for pairs of terms that follow each other in some item's order (rarest first) the
intersection of both lists, and of it the largest joint impact and the ``k``-th largest. An
item has one pair fewer than terms, and pairs are shared by all items.

*Search.* In a shard, an item starts with the best ``k``-th impact of its lists as
threshold: that many documents reach it. What the terms from some place on can add is
bounded by a dynamic program that takes each term alone, with its own maximum, or two
neighbours together, with the pair's joint maximum (or the larger single one, for a
document that has but one of them). This is never above the sum of independent maxima, and
below it wherever two maxima are not met in one document. Once the bound falls under the
threshold the lists that are left open no new documents; only documents already met that
can still reach the threshold are looked up in them. The threshold rises with the
``k``-th best sum so far. Equality never excludes, so ties stay.

Scale: nothing is shuffled but at most ``k`` rows for an item and shard. A frequent term's
list is spread over all shards. Shards are bounded by documents and postings. The items
are a query set; they are sent to tasks in blocks of bounded size, one search for each.

Defined results: a null or termless text is no document (it counts in neither N nor L);
an item without terms has no rows; a null item_id or doc_id is an id of its own, null ids
last among equal scores; rows that repeat an item id are one item with all their terms;
rows that repeat a doc_id are documents each, and come out each, in the order of their
texts' lengths; further columns, of any name, are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from oligo_engine.llm.common import Scratch, checkpoint, list_column, map_arrow

#: Bytes of terms (0-9, A-Z, a-z and all above 7F), in lower case; others part them.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: A shard ends at so many documents or postings, whichever comes first.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 20
#: Items are searched in blocks of at most so many, and of so many bytes of terms.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 1 << 25
K = 10


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (binary, distinct) of every item that has terms."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t.as_py()))) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    cut_up = map_arrow(items.select("item_id", "text"), cut, f"item_id {kind}, terms array<binary>")
    return cut_up.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def blocks_of(listed: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items' (id, terms), some at a time, by way of the driver: a query set."""
    block, size = [], 0
    for item, terms in listed.toLocalIterator():
        block.append((item, [bytes(t) for t in terms]))
        size += sum(len(t) + 40 for t in terms)
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def forward(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tf of the numbered terms of every document
    that has a term."""
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in batches:
            n, terms, tf, sizes = [], [], [], []
            for t in batch.column(1):
                words = terms_of(t.as_py())
                n.append(len(words))
                counts = Counter(words)
                own = sorted((number[w], counts[w]) for w in counts.keys() & number.keys())
                terms += [x for x, _ in own]
                tf += [c for _, c in own]
                sizes.append(len(own))
            has = pa.array([x > 0 for x in n], pa.bool_())
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    list_column(np.array(terms, np.int32), np.array(sizes, np.int64)),
                    list_column(np.array(tf, np.int32), np.array(sizes, np.int64)),
                ],
                ["doc_id", "n", "terms", "tf"],
            ).filter(has)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), count, f"doc_id {kind}, n long, terms array<int>, tf array<int>")


class Items:
    """A block of items over numbered terms: for each its terms, rarest first, and the
    pairs of neighbours in that order."""

    def __init__(self, block: list[tuple[object, list[bytes]]], number: dict[bytes, int], frequency: dict[int, int], documents: int):
        self.weight = np.zeros(len(number), np.int64)
        for t, df in frequency.items():
            self.weight[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        self.terms = []
        for _, terms in block:
            known = [number[t] for t in terms if frequency.get(number[t])]
            self.terms.append(np.array(sorted(known, key=lambda t: (frequency[t], t)), np.int32))
        pairs = {p for own in self.terms for p in zip(own[:-1].tolist(), own[1:].tolist())}
        self.pairs = np.array(sorted(pairs), np.int32).reshape(-1, 2)
        place = {(a, b): i for i, (a, b) in enumerate(self.pairs.tolist())}
        self.pair_places = [np.array([place[p] for p in zip(own[:-1].tolist(), own[1:].tolist())], np.int32) for own in self.terms]


SHARD = "ids array<{kind}>, lengths array<long>, starts array<int>, docs array<int>, saturation array<int>, top array<long>, kth array<long>, joint array<long>, joint_kth array<long>"


def kth_largest(values: np.ndarray, k: int) -> int:
    """0 if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


class Shard:
    """Lists of one run of documents, and the bounds of terms and pairs."""

    def __init__(self, starts, docs, saturation, top, kth, joint, joint_kth):
        self.starts, self.docs, self.saturation = starts, docs, saturation
        self.top, self.kth, self.joint, self.joint_kth = top, kth, joint, joint_kth

    @classmethod
    def build(cls, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, items: Items, n: int, total: int, k: int) -> Shard:
        norm = 10 + (90 * lengths * n) // total
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), sizes)
        order = np.argsort(terms, kind="stable")
        docs = doc[order]
        tf = tf[order].astype(np.int64)
        saturation = ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[docs])).astype(np.int32)
        vocabulary = len(items.weight)
        starts = np.searchsorted(terms[order], np.arange(vocabulary + 1)).astype(np.int32)
        top, kth = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)
        for t in np.flatnonzero(np.diff(starts)):
            impacts = saturation[starts[t] : starts[t + 1]]
            top[t] = items.weight[t] * impacts.max()
            kth[t] = items.weight[t] * kth_largest(impacts, k)
        joint, joint_kth = np.zeros(len(items.pairs), np.int64), np.zeros(len(items.pairs), np.int64)
        here = np.full(len(lengths), -1, np.int32)
        last = -1
        for p, (a, b) in enumerate(items.pairs.tolist()):
            own = slice(starts[a], starts[a + 1])
            other = slice(starts[b], starts[b + 1])
            if own.start == own.stop or other.start == other.stop:
                continue
            if a != last:  # pairs come sorted by their first term
                here.fill(-1)
                here[docs[own]] = np.arange(own.stop - own.start, dtype=np.int32)
                last = a
            at = here[docs[other]]
            both = at >= 0
            if both.any():
                sums = items.weight[a] * saturation[own][at[both]].astype(np.int64) + items.weight[b] * saturation[other][both].astype(np.int64)
                joint[p], joint_kth[p] = sums.max(), kth_largest(sums, k)
        return cls(starts, docs, saturation, top, kth, joint, joint_kth)

    def bounds(self, own: np.ndarray, pairs: np.ndarray, use_pairs: bool = True) -> list[int]:
        """What the terms from each place on can add to a document at most."""
        single = self.top[own].tolist()
        joint = self.joint[pairs].tolist()
        out = [0] * (len(own) + 1)
        for i in range(len(own) - 1, -1, -1):
            out[i] = out[i + 1] + single[i]
            if use_pairs and i + 1 < len(own):
                out[i] = min(out[i], out[i + 2] + max(joint[i], single[i], single[i + 1]))
        return out

    def search(self, own: np.ndarray, pairs: np.ndarray, weight: np.ndarray, k: int, use_pairs: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores) that can be among the k best, and the postings read."""
        bounds = self.bounds(own, pairs, use_pairs)
        least = max([1, *self.kth[own].tolist(), *(self.joint_kth[pairs].tolist() if use_pairs else [])])
        sums = np.zeros(int(self.docs.max()) + 1 if len(self.docs) else 0, np.int64)
        met, read = None, 0
        for i, t in enumerate(own.tolist()):
            listed = slice(self.starts[t], self.starts[t + 1])
            if listed.start == listed.stop:
                continue
            docs, gains = self.docs[listed], weight[t] * self.saturation[listed].astype(np.int64)
            if met is None and bounds[i] < least:  # from here on no new document can reach it
                met = np.flatnonzero(sums)
            if met is None:
                sums[docs] += gains
                read += len(docs)
                continue
            met = met[sums[met] + bounds[i] >= least]
            if not len(met):
                break
            at = np.searchsorted(docs, met)
            at[at == len(docs)] = 0
            hit = docs[at] == met
            sums[met[hit]] += gains[at[hit]]
            read += len(met)
            least = max(least, kth_largest(sums[met], k))
        met = np.flatnonzero(sums) if met is None else met
        least = max(least, kth_largest(sums[met], k))
        met = met[sums[met] >= least]
        return met, sums[met], read


def cut_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, lengths, sizes, terms, tf) of runs of documents of bounded size."""

    def joined(held):
        columns = [pa.concat_arrays([b.column(c) for b in held]) for c in range(4)]
        sizes = np.diff(columns[2].offsets.to_numpy()).astype(np.int64)
        return columns[0], columns[1].to_numpy(), sizes, columns[2].flatten().to_numpy(), columns[3].flatten().to_numpy()

    held, docs, postings = [], 0, 0
    for batch in batches:
        ends = batch.column(2).offsets.to_numpy()
        first = 0
        while first < batch.num_rows:
            room = np.searchsorted(ends, ends[first] + SHARD_POSTINGS - postings, "right") - 1
            last = min(batch.num_rows, max(first + (not held), room), first + SHARD_DOCS - docs)
            if last > first:
                held.append(batch.slice(first, last - first))
                docs, postings = docs + last - first, postings + int(ends[last] - ends[first])
            if last < batch.num_rows:
                yield joined(held)
                held, docs, postings = [], 0, 0
            first = last
    if held:
        yield joined(held)


def build_index(forwards: DataFrame, items, n: int, total: int, k: int) -> DataFrame:
    """The shards: a row each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lengths, sizes, terms, tf in cut_shards(batches):
            s = Shard.build(lengths, sizes, terms, tf, items.value, n, total, k)
            columns = [lengths, s.starts, s.docs, s.saturation, s.top, s.kth, s.joint, s.joint_kth]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[list_column(c, np.array([len(c)])) for c in columns]]
            yield pa.record_batch(lists, [x.split()[0] for x in SHARD.split(", ")])

    kind = forwards.schema["doc_id"].dataType.simpleString()
    return map_arrow(forwards, build, SHARD.format(kind=kind))


def search_index(shards: DataFrame, items, k: int) -> DataFrame:
    """item (its number), doc_id, n, score: what each shard has to offer, k for an item at most."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, lengths, *lists = [batch.column(c)[r].values for c in range(batch.num_columns)]
                lengths, shard = lengths.to_numpy(), Shard(*[x.to_numpy() for x in lists])
                found, numbers, scores = [], [], []
                for i, (own, pairs) in enumerate(zip(items.value.terms, items.value.pair_places)):
                    docs, sums, _ = shard.search(own, pairs, items.value.weight, k)
                    if len(docs) > k:
                        order = np.lexsort((lengths[docs], ids.take(pa.array(docs)).to_pandas().rank(method="dense", na_option="bottom").to_numpy(), -sums))[:k]
                        docs, sums = docs[order], sums[order]
                    found.append(docs)
                    scores.append(sums)
                    numbers.append(np.full(len(docs), i, np.int32))
                if found:
                    at = np.concatenate(found)
                    yield pa.record_batch(
                        [pa.array(np.concatenate(numbers)), ids.take(pa.array(at)), pa.array(lengths[at]), pa.array(np.concatenate(scores))],
                        ["item", "doc_id", "n", "score"],
                    )

    kind = shards.schema["ids"].dataType.elementType.simpleString()
    return map_arrow(shards, search, f"item int, doc_id {kind}, n long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    spark: SparkSession = docs.sparkSession
    results = None
    with Scratch(spark) as tables:
        listed = tables.keep(item_terms(items))
        for block in blocks_of(listed):
            number = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
            forwards = tables.keep(forward(docs, number))
            n, total = forwards.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
            # as many rows as the block has terms
            frequency = dict(forwards.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator())
            held = spark.sparkContext.broadcast(Items(block, number, frequency, n))
            shards = tables.keep(build_index(forwards, held, n, total, k))
            order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n")]
            best = (
                search_index(shards, held, k)
                .withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order)))
                .filter(F.col("rank") <= k)
            )
            names = spark.createDataFrame(
                [(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}"
            )
            rows = checkpoint(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
            results = rows if results is None else results.unionByName(rows)
    if results is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    return results
