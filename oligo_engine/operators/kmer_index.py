"""A transcriptome index that is built in one pass, stored and used again.

K-mers are numbers of two bits a nucleotide; only windows with other letters are kept as
text. The records are read once, into pieces. A stored index counts every window by its
number; the hexamer that starts a window is the top of that number, so the seed counts come
from the counted table. Without a path hexamers are counted from the pieces, and k-mers are
gathered to bits where they are searched.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from oligo_engine import constants as K
from oligo_engine.functions.sequence import reverse_complement, slow_code, to_rna
from oligo_engine.operators.ordering import materialise
from oligo_engine.operators.tiling import HALO, PIECE, as_pieces, starts

#: Nucleotides of one packed word; a window of up to 17 lies in two neighbours.
WORD = 16
SEED = K.SEED_K
STRAND = K.STRAND_LENGTH
OTHER = "[^ACGU]"
#: Up to this length all k-mers are 4^k / 64 words of a bit each (1,048,576 at most), a
#: broadcast bounded by its key; longer ones are bits of blocks (``blocks``).
BROADCAST_K = 13
# a place whose hexamer recurs one to five places on, so that the two overlap
RECURS = r"(?=([ACGU]{6}))(?=.{1,5}\1)"
#: Eleven places in a row that do not recur: no overlapping pair of hexamers (eleven
#: characters at most) crosses the end of such a stretch.
QUIET = rf"(?:(?!{RECURS}).){{11}}"


@dataclass(frozen=True)
class KmerIndex:
    """``kmers``: code (bigint), and letters if others than ACGU, of every different k-mer.  ``seeds``: site,
    seed_occurrences of every hexamer, without overlaps.  ``codes``: the codes of ACGU alone, repeats included."""

    k: int
    kmers: DataFrame
    seeds: DataFrame
    codes: DataFrame


def packed(text: Column) -> Column:
    """Two bits a nucleotide, 16 of them a number, and two numbers of zeros at the end."""
    digits = F.concat(F.translate(text, "ACGU", "0123"), F.lit("0" * (3 * WORD - 1)))
    words = F.regexp_extract_all(digits, F.lit(f".{{{WORD}}}"), F.lit(0))
    long = F.transform(words, lambda w: F.conv(w, 4, 10).cast("bigint"))
    # a guide's target site is two numbers
    short = F.array(*[slow_code(F.rpad(F.substring(text, 1 + i * WORD, WORD), WORD, "A")) for i in range(2)], F.lit(0).cast("bigint"))
    return F.when(F.length(text) <= 2 * WORD, short).otherwise(long)


def code_at(words: str, at: str, k: int) -> Column:
    """The number of the ``k`` nucleotides from the 1-based place ``at`` on."""
    if k > WORD:
        return F.shiftleft(code_at(words, at, WORD), 2 * (k - WORD)).bitwiseOR(code_at(words, f"({at} + {WORD})", k - WORD))
    w, r = f"CAST(({at} - 1) DIV {WORD} AS INT)", f"(({at} - 1) % {WORD})"
    both = f"shiftleft({words}[{w}], 32) | {words}[{w} + 1]"
    return F.expr(f"shiftrightunsigned({both}, CAST(64 - 2 * ({r} + {k}) AS INT)) & {(1 << 2 * k) - 1}L")


def spelled(code: Column, k: int) -> Column:
    """The nucleotides of a number."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGU")


def letters_code(window: Column) -> Column:
    """A negative number for a window with other letters, which are compared besides."""
    return -1 - F.xxhash64(window).bitwiseAND(F.lit((1 << 62) - 1))


def coded_windows(df: DataFrame, text: str, k: int, hexamers: bool = True) -> DataFrame:
    """``df`` with a row for every window of ``text``: code of the k-window there, and its
    letters where it holds others than ACGU.

    With ``hexamers`` there is a row for every hexamer, and the code of the hexamer where
    the code does not begin with it: at the end, where there is no k-window (null), or
    before other letters. A text of pure ACGU, nearly all, goes by numbers alone.
    """
    if not SEED <= k <= HALO + 1:
        raise ValueError(f"k is between {SEED} and {HALO + 1}")
    t = F.col(text)
    rows = df.withColumns({"_pure": ~t.rlike(OTHER), "_words": packed(t), "_n": F.length(t)})
    rows = rows.withColumn("_at", F.explode(starts(t, SEED if hexamers else k)))
    window, seed = F.substr(t, F.col("_at"), F.lit(k)), F.substr(t, F.col("_at"), F.lit(SEED))
    whole, odd = F.col("_at") + (k - 1) <= F.col("_n"), ~F.col("_pure") & window.rlike(OTHER)
    numbered = F.when(F.col("_pure"), code_at("_words", "_at", k)).when(odd, letters_code(window)).otherwise(slow_code(window))
    if not hexamers:  # every row has a code
        rows = rows.withColumns({"code": F.coalesce(numbered, F.lit(0)), "letters": F.when(odd, window)})
    else:
        rows = rows.withColumns({"code": F.when(whole, numbered), "letters": F.when(whole & odd, window)})
        of_seed = F.when(F.col("_pure"), code_at("_words", "_at", SEED)).when(~seed.rlike(OTHER), slow_code(seed))
        rows = rows.withColumn("hexamer", F.when(F.coalesce(F.col("code") < 0, F.lit(True)), of_seed))
    return rows.drop("_pure", "_words", "_n", "_at")


def corrections(pieces: DataFrame, key: str) -> DataFrame:
    """site, n: what hexamers that overlap themselves were counted too often, in rows.

    Texts are cut where no overlapping pair crosses: what lies between the first and the
    last such place of a piece is judged where it stands, only the ends next to a
    neighbour, some dozen characters, are put together.
    """
    own = F.substring("piece", 1, PIECE)
    room = PIECE - 11
    edge = pieces.select(
        key,
        "start",
        own.alias("_own"),
        F.length(F.regexp_extract("piece", f"(?s)^.{{0,{room}}}?{QUIET}", 0)).alias("_first"),
        F.length(F.regexp_extract("piece", f"(?s)^.{{0,{room}}}{QUIET}", 0)).alias("_last"),
    )
    inner = edge.filter(F.col("_first") < F.col("_last")).select(
        F.substr(F.col("_own"), F.col("_first") + 1, F.col("_last") - F.col("_first")).alias("_text")
    )
    cut = F.col("_first") > 0
    head = F.when(cut, F.substr(F.col("_own"), F.lit(1), F.col("_first"))).otherwise(F.col("_own"))
    tail = F.substr(F.col("_own"), F.col("_last") + 1, F.length("_own"))
    ends = edge.select(
        key,
        F.explode(
            F.array(
                F.struct(F.col("start").alias("_at"), F.lit(0).alias("_side"), head.alias("_text"), F.lit(0).alias("_new")),
                F.struct(F.col("start").alias("_at"), F.lit(1).alias("_side"), F.when(cut, tail).alias("_text"), cut.cast("int").alias("_new")),
            )
        ).alias("_e"),
    ).select(key, "_e.*")
    # a tail opens a stretch that goes on to the next place where it may be cut
    along = W.partitionBy(key).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = (
        ends.withColumn("_stretch", F.sum("_new").over(along))
        .filter(F.length("_text") > 0)
        .groupBy(key, "_stretch")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_side", "_text"))).alias("_parts"))
        .select(F.array_join("_parts._text", "").alias("_text"))
    )
    recurring = F.array_distinct(F.regexp_extract_all("_text", F.lit(RECURS), F.lit(1)))
    overlapping = F.regexp_count("_text", F.concat(F.lit("(?="), F.col("site"), F.lit(")")))
    return (
        inner.unionByName(joined)
        .select("_text", F.explode(recurring).alias("site"))
        .select("site", (F.regexp_count("_text", F.col("site")) - overlapping).cast("bigint").alias("n"))
        .groupBy("site")
        .agg(F.sum("n").alias("n"))
    )


def build_index(
    records: DataFrame, k: int = K.OFFTARGET_K, path: str | None = None, key: str = "record_id", exclude: DataFrame | None = None
) -> KmerIndex:
    """Index of ``records`` (``key``, sequence; or pieces: ``key``, start, piece).

    Read once: pieces are written, then counted. ``path`` stores the index for other
    sessions (``open_index``), bucketed by code. The records named in ``exclude`` are left
    out of the k-mers but not of the seed counts.
    """
    rna = "piece" if "piece" in records.columns else "sequence"
    pieces = as_pieces(records.withColumn(rna, to_rna(F.col(rna))), key)
    searched = F.lit(True)
    if exclude is not None:
        gone = exclude.select(key).distinct().withColumn("_gone", F.lit(True))
        pieces = pieces.join(gone, key, "left")
        searched = F.col("_gone").isNull()
    pieces = materialise(pieces.withColumn("_searched", searched).drop("_gone"))
    spark = records.sparkSession
    if path is None:
        found = coded_windows(pieces.filter("_searched").select("piece"), "piece", k, hexamers=False).select("code", "letters")
        hexamers = coded_windows(pieces.select("piece"), "piece", SEED, hexamers=False).filter("letters IS NULL")
        histogram = hexamers.groupBy(F.col("code").alias("_h")).agg(F.count(F.lit(1)).alias("n"))
    else:
        rows = coded_windows(pieces.select("piece", "_searched"), "piece", k)
        counted = rows.groupBy("code", "letters", "hexamer").agg(F.count(F.lit(1)).alias("n"), F.max("_searched").alias("searched"))
        table = _store(counted, k, f"{path}/kmers")
        top = F.coalesce(F.col("hexamer"), F.expr(f"CASE WHEN letters IS NULL THEN shiftrightunsigned(code, {2 * (k - SEED)}) END"))
        histogram = table.select(top.alias("_h"), "n").filter("_h IS NOT NULL").groupBy("_h").agg(F.sum("n").alias("n"))
    seeds = (
        histogram.select(spelled(F.col("_h"), SEED).alias("site"), "n")
        .unionByName(corrections(pieces, key))
        .groupBy("site")
        .agg(F.sum("n").alias("seed_occurrences"))
    )
    if path is None:
        return KmerIndex(k, found.distinct(), seeds, _pure(found))
    seeds.write.parquet(f"{path}/seeds")
    about = json.dumps({"k": k, "buckets": _buckets(spark)})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/about")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> KmerIndex:
    """A stored index; nothing is read but its description."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    kmers = _searched(_named(spark, f"{path}/kmers", about["buckets"]))
    seeds = spark.read.schema("site string, seed_occurrences bigint").parquet(f"{path}/seeds")
    return KmerIndex(about["k"], kmers, seeds, _pure(kmers))


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _searched(table: DataFrame) -> DataFrame:
    return table.filter("searched AND code IS NOT NULL").select("code", "letters")


def _pure(kmers: DataFrame) -> DataFrame:
    return kmers.filter("letters IS NULL").select("code")


def _store(counted: DataFrame, k: int, path: str) -> DataFrame:
    """Bucketed by code, so that a join on it leaves the index where it is."""
    spark, name = counted.sparkSession, f"kmers_{uuid.uuid4().hex}"
    n = _buckets(spark)
    counted.repartition(n, "code").write.bucketBy(n, "code").sortBy("code").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def _named(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The stored table under a name of this session, which tells Spark of its buckets."""
    name = f"kmers_{uuid.uuid4().hex}"
    columns = "code BIGINT, letters STRING, hexamer BIGINT, n BIGINT, searched BOOLEAN"
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (code) SORTED BY (code) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def target_codes(candidates: DataFrame, k: int = K.OFFTARGET_K) -> DataFrame:
    """(antisense, code, letters) of the distinct target sites: 21 - k + 1 rows per guide."""
    sites = candidates.select("antisense").distinct().withColumn("_site", reverse_complement(F.upper("antisense")))
    return coded_windows(sites, "_site", k, hexamers=False).select("antisense", "code", "letters")


def same_window(a: str, b: str) -> Column:
    """One code, and no other letters that differ (which only hashed windows can)."""
    other = F.col(f"{a}.letters") != F.col(f"{b}.letters")
    return (F.col(f"{a}.code") == F.col(f"{b}.code")) & ~F.coalesce(other, F.lit(False))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int"))


def _is_set(bits: Column, at: Column) -> Column:
    return F.call_function("shiftright", bits, at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def _low(x: Column, letters: int) -> Column:
    return x.bitwiseAND(F.lit((1 << 2 * letters) - 1))


def _joined(high: Column, low: Column, letters: int) -> Column:
    return F.shiftleft(high, 2 * letters).bitwiseOR(low)


def words(codes: DataFrame) -> DataFrame:
    """word, bits: the codes as a bit each, 64 to a word."""
    return codes.groupBy(F.shiftright("code", 6).alias("word")).agg(F.bit_or(_bit(F.col("code"))).alias("bits"))


def _turned(shift: int) -> list[int]:
    """Offsets of the core in a k-mer at which fewer than three letters follow it."""
    return [o for o in range(shift + 1) if shift >= 5 and shift - o < 3]


def blocks(codes: DataFrame, k: int) -> DataFrame:
    """core, sums, base, packed: one row for all k-mers that a guide with that core can hold.

    The 22 - k windows of a target site share its middle, 2k - 21 letters. A k-mer may
    hold a core at each of 22 - k offsets; the letters around it number its bit (``_places``).
    ``packed`` has the words of 64 bits that are not empty, ``sums`` a bit for every word
    that is there, ``base`` how many stand before each sum. Codes are gathered to words
    before they are told by core, so what is moved is bounded by 4^k, not by the records.
    """
    m, core = STRAND - k, 2 * k - STRAND

    def rows(name: str, first: int, offsets: list[int]) -> Column:
        """Of a number of ``first`` letters, which the word's own three letters follow or precede."""
        x, out = F.col(name), []
        for o in offsets:
            after = m - o if o in _turned(m) else m - o - (k - first)
            before = o - (k - first) if o in _turned(m) else o
            rest = _joined(F.shiftright(x, 2 * (core + after)) if before else F.lit(0).cast("bigint"), _low(x, after), after)
            place = rest + o * 4 ** (m - (k - first))
            out.append(F.struct(_low(F.shiftright(x, 2 * after), core).alias("core"), place.alias("at")))
        return F.explode(F.array(*out))

    if m >= 5:
        last, first = [o for o in range(m + 1) if o not in _turned(m)], _turned(m)
        head = words(codes).select(rows("word", k - 3, last).alias("_r"), "bits")
        turned = codes.groupBy(_low(F.col("code"), k - 3).alias("word")).agg(
            F.bit_or(_bit(F.shiftright("code", 2 * (k - 3)))).alias("bits")
        )
        told = head.unionByName(turned.select(rows("word", k - 3, first).alias("_r"), "bits")).select("_r.core", F.col("_r.at").alias("word"), "bits")
    else:
        told = codes.select(rows("code", k, list(range(m + 1))).alias("_r")).groupBy(
            "_r.core", F.shiftright("_r.at", 6).alias("word")
        ).agg(F.bit_or(_bit(F.col("_r.at"))).alias("bits"))
    n = ((m + 1) * 4**m + 4095) // 4096
    word = F.col("word")
    sums = [F.bit_or(F.when(F.shiftright(word, 6) == j, _bit(word)).otherwise(F.lit(0).cast("bigint"))) for j in range(n)]
    return told.groupBy("core").agg(
        F.array(*sums).alias("sums"),
        F.array(*[F.count_if(word < 64 * j).cast("int") for j in range(n)]).alias("base"),
        F.array_sort(F.collect_list(F.struct("word", "bits"))).getField("bits").alias("packed"),
    )


def _places(site: Column, k: int) -> list[Column]:
    """Where in its core's block the bits of a target site's windows stand."""
    m, out = STRAND - k, []
    left, right = F.shiftright(site, 2 * (STRAND - m)), _low(site, m)
    for o in range(m + 1):
        prefix, suffix = _low(left, o), F.shiftright(right, 2 * o)
        if o in _turned(m):
            rest = _joined(_joined(_low(prefix, o - 3), suffix, m - o), F.shiftright(prefix, 2 * (o - 3)), 3)
        else:
            rest = _joined(prefix, suffix, m - o)
        out.append(rest + o * 4**m)
    return out


def _in_block(place: Column) -> Column:
    word = F.shiftright(place, 6)
    at = F.shiftright(word, 6).cast("int")
    there = F.get("sums", at)
    before = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), word.bitwiseAND(63).cast("int")))
    index = F.get("base", at) + F.bit_count(there.bitwiseAND(before))
    return _is_set(there, word) & _is_set(F.get("packed", index), place)


def plain(antisense: Column) -> Column:
    """Whether a guide has 21 letters, all of them ACGU."""
    return F.coalesce(antisense.rlike(f"^[ACGU]{{{STRAND}}}$"), F.lit(False))


def _site(antisense: Column) -> Column:
    """The number of a plain guide's target site; null for others."""
    return F.when(plain(antisense), F.conv(F.reverse(F.translate(antisense, "UGCA", "0123")), 4, 10).cast("bigint"))


def _guide(site: Column) -> Column:
    return F.reverse(F.translate(F.lpad(F.conv(site.cast("string"), 10, 4), STRAND, "0"), "0123", "UGCA"))


def _in_words(rows: DataFrame, index: KmerIndex) -> tuple[DataFrame, Column]:
    """``rows`` with the word of every window of ``_site``, and whether one of them is in the index."""
    table, tests = words(index.codes), []
    for i in range(STRAND - index.k + 1):
        code = _low(F.shiftright("_site", 2 * (STRAND - index.k - i)), index.k)
        side = F.broadcast(table.select(F.col("word").alias(f"_word{i}"), F.col("bits").alias(f"_bits{i}")))
        rows = rows.join(side, F.shiftright(code, 6) == F.col(f"_word{i}"), "left")
        tests.append(F.coalesce(_is_set(F.col(f"_bits{i}"), code), F.lit(False)))
    return rows, reduce(or_, tests)


def _with_core(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("_core", _low(F.shiftright("_site", 2 * (STRAND - k)), 2 * k - STRAND))


def _in_blocks(index: KmerIndex) -> tuple[DataFrame, Column]:
    """The blocks, and whether one of a row's windows is in its block; not sorted for the join."""
    tests = [_in_block(place) for place in _places(F.col("_site"), index.k)]
    return blocks(index.codes, index.k).hint("shuffle_hash"), F.coalesce(reduce(or_, tests), F.lit(False))


def _other_guides(candidates: DataFrame, index: KmerIndex) -> DataFrame | None:
    """Critical guides among those of other letters or lengths, by a join on k-mers; none where there are no such guides."""
    odd = materialise(candidates.select("antisense").filter(F.col("antisense").isNotNull() & ~plain(F.col("antisense"))).distinct())
    if odd.isEmpty():
        return None
    sought = target_codes(odd, index.k).alias("s")
    return sought.join(index.kmers.alias("i"), same_window("s", "i"), "left_semi").select("antisense").distinct()


def critical_guides(candidates: DataFrame, index: KmerIndex) -> DataFrame:
    """Distinct guides that share a k-mer with the index (left semi join).

    Guides of 21 letters ACGU go as one number each to the bits of the index.
    """
    rows = candidates.select(_site(F.col("antisense")).alias("_site")).filter("_site IS NOT NULL")
    if index.k <= BROADCAST_K:
        rows, hit = _in_words(rows.distinct(), index)
        found = rows.filter(hit).select("_site")
    else:
        table, hit = _in_blocks(index)
        rows = _with_core(rows, index.k)
        semi = rows.join(table, (rows["_core"] == table["core"]) & hit, "left_semi")
        found = semi.select("_core", "_site").distinct()  # stays where the join left it
    guides = found.select(_guide(F.col("_site")).alias("antisense"))
    others = _other_guides(candidates, index)
    return guides if others is None else guides.unionByName(others)


def with_match(candidates: DataFrame, index: KmerIndex) -> DataFrame:
    """Flag candidates whose guide shares a k-mer with the index as ``has_critical_match``.

    A candidate meets the bits of the index itself: it moves once, for long k-mers, or not
    at all, and no list of guides is made.
    """
    rows = candidates.withColumn("_site", _site(F.col("antisense")))
    if index.k <= BROADCAST_K:
        rows, hit = _in_words(rows, index)
    else:
        table, hit = _in_blocks(index)
        # guides without a number have no block; they are dealt out by their letters
        rows = _with_core(rows, index.k).withColumn("_core", F.coalesce("_core", -1 - F.abs(F.hash("antisense").cast("bigint"))))
        rows = rows.join(table, F.col("_core") == F.col("core"), "left")
    flagged = rows.withColumn("has_critical_match", hit).select(*candidates.columns, "has_critical_match")
    others = _other_guides(candidates, index)
    if others is None:
        return flagged
    named = others.withColumn("_other", F.lit(True))
    return flagged.join(named, "antisense", "left").select(
        *candidates.columns, (F.col("has_critical_match") | F.coalesce("_other", F.lit(False))).alias("has_critical_match")
    )


def matching_guides(candidates: DataFrame, records: DataFrame, k: int = K.OFFTARGET_K, key: str = "record_id") -> DataFrame:
    """Like ``critical_guides`` for few candidates, without an index of the transcriptome.

    The sought codes are written first, so their size is known: below Spark's broadcast
    threshold the windows of the transcriptome are filtered where they are cut and never
    shuffled; more of them are joined by shuffle, with the same result.
    """
    sought = materialise(target_codes(candidates, k))
    rna = "piece" if "piece" in records.columns else "sequence"
    cut = coded_windows(as_pieces(records.withColumn(rna, to_rna(F.col(rna))), key).select("piece"), "piece", k, hexamers=False)
    found = cut.alias("c").join(sought.alias("s"), same_window("c", "s"), "left_semi").select("code", "letters").distinct()
    return sought.alias("s").join(found.alias("f"), same_window("s", "f"), "left_semi").select("antisense").distinct()
