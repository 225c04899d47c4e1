"""Token counts by a map-side two-tier lookup; no pre-token is ever shuffled.

Tier one is a compact table of frequent pre-tokens and their token counts, broadcast to
all tasks: at most ``table_size`` entries, learned on at most ``table_docs`` texts of at
most ``table_chars`` characters each (bounds that only decide what is quick, never a
count). Tier two is a cache in each worker that encodes a pre-token when it first misses
and is emptied at ``cache_size`` entries.

A null text counts as empty: 0 bytes, 0 tokens. Null and repeated ids, repeated rows and
further columns pass unharmed; an empty table gives an empty result. Special strings in
a text are one token each, as the tokenizer file has them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from oligo_engine.llm.common import map_arrow

#: Fixed value: the byte-level pre-tokenizer's pattern, with its white space spelt out.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same pattern for texts of ASCII and Latin letters alone, which are most texts: plain
#: character ranges are several times as fast as property classes.
LATIN = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
LATIN_TEXT = rf"[\x00-\x7F{LATIN}]*"
LATIN_PATTERN = (
    rf" ?[{LATIN}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\t-\r {LATIN}0-9]+"
    r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
#: Texts longer than this are walked match by match instead of listed.
LISTED_CHARS = 1 << 18


class Lengths(dict):
    """Token count by pre-token; misses are encoded and kept up to a bound."""

    def __init__(self, known: dict[str, int], encode, bound: int):
        super().__init__(known)
        self.known, self.encode, self.bound = known, encode, bound

    def __missing__(self, piece: str) -> int:
        n = self.encode(piece)
        if len(self) >= self.bound:
            self.clear()
            self.update(self.known)
        self[piece] = n
        return n


class Splitter:
    """Pre-tokens of a text, and the token count of one pre-token, for a byte-level BPE file."""

    def __init__(self, tokenizer_path: str):
        import json
        import re

        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(tokenizer_path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.model = Tokenizer.from_file(tokenizer_path).model
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.latin_text, self.latin, self.any = re.compile(LATIN_TEXT), re.compile(LATIN_PATTERN), regex.compile(PATTERN)
        # the library's character for each byte, read off texts that have every byte
        every = "".join(map(chr, [*range(0x800), *range(0x800, 0xD800, 0x800), *range(0xE000, 0x10000, 0x800)]))
        every += "".join(map(chr, range(0x10000, 0x110000, 0x10000)))
        mapped = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(every)[0][0]
        self.symbols = dict(zip(every.encode(), mapped))

    def encode(self, piece: str) -> int:
        """Tokens of one pre-token."""
        return len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.symbols)))

    def parts(self, text: str) -> list[str]:
        return self.special.split(text) if self.special else [text]

    def pattern(self, text: str):
        return self.latin if self.latin_text.fullmatch(text) else self.any


def count_tokens(text: str, splitter: Splitter, lengths: Lengths) -> int:
    parts = splitter.parts(text)
    total = len(parts) - 1
    for part in parts:
        pattern = splitter.pattern(part)
        if len(part) <= LISTED_CHARS:
            total += sum(map(lengths.__getitem__, pattern.findall(part)))
        else:
            total += sum(lengths[m[0]] for m in pattern.finditer(part))
    return total


def frequent_lengths(
    docs: DataFrame, tokenizer_path: str, table_size: int, table_docs: int, table_chars: int
) -> dict[str, int]:
    """The compact table: most frequent pre-tokens of a bounded sample, by count."""
    sample = docs.select(F.substring("text", 1, table_chars).alias("text")).filter(F.col("text").isNotNull()).limit(table_docs)
    splitter, seen = Splitter(tokenizer_path), Counter()
    for (text,) in sample.collect():
        for part in splitter.parts(text):
            seen.update(splitter.pattern(part).findall(part))
    ranked = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:table_size]
    return {piece: splitter.encode(piece) for piece, _ in ranked}


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 1024,
    table_size: int = 50_000,
    table_docs: int = 1000,
    table_chars: int = 4096,
    cache_size: int = 400_000,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text."""
    table = frequent_lengths(docs, tokenizer_path, table_size, table_docs, table_chars)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(tokenizer_path)
        lengths = Lengths(shared.value, splitter.encode, cache_size)
        for batch in batches:
            n = [count_tokens(t, splitter, lengths) if t else 0 for t in (v.as_py() for v in batch.column(1))]
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return map_arrow(docs.select("doc_id", "text", size), count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
