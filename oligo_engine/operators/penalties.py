"""Rule-based penalties of modified duplexes.

Each rule is a ``(condition, points, reason)`` triple.  Totals sum the points; the
optional breakdown keeps the reasons.  Rules read the variant columns ``sense,
antisense, open_sense, open_antisense`` (see ``variants``) and the parent strands.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from oligo_engine import constants as K
from oligo_engine.functions.chemistry import COVERED, FLUORO_PYRIMIDINE, exposure_mark
from oligo_engine.functions.sequence import (
    count_in,
    count_of,
    gc_percent,
    has_gc_run,
    has_homopolymer,
    has_palindrome,
    overlapping_count,
)

DOMAINS = ["nuclease", "immuno", "risc", "thermo", "serum"]


@dataclass
class Rule:
    points: Column  # 0 where the rule does not apply
    reasons: Callable[[], Column]  # array of (reason, points); built only for breakdowns


def _char(strand: str | Column, position: int) -> Column:
    return F.substring(strand, position, 1)


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _entry(reason: Column, points: Column) -> Column:
    return F.struct(reason.alias("reason"), points.cast("double").alias("points"))


def _listed(condition: Column, entries: Callable[[], Column]) -> Callable[[], Column]:
    nothing = "array<struct<reason:string,points:double>>"
    return lambda: F.when(condition, entries()).otherwise(F.array().cast(nothing))


def _flag(condition: Column, points: float, reason: str | Column) -> Rule:
    """Fixed points under one condition."""
    text = F.lit(reason) if isinstance(reason, str) else reason
    hit = F.coalesce(condition, F.lit(False))
    value = F.lit(float(points))
    return Rule(
        F.when(hit, value).otherwise(F.lit(0.0)),
        _listed(hit, lambda: F.array(_entry(text, value))),
    )


def _counted(count: Column, points: float, reason: str, slot: str) -> Rule:
    """Points per hit under one reason that states the count."""
    value = count * F.lit(float(points))

    def entries() -> Column:
        return F.array(_entry(F.replace(F.lit(reason), F.lit(slot), count.cast("string")), value))

    return Rule(value, _listed(count > 0, entries))


def _placed(count: Column, hit_at, first: int, last: Column, points: float, reason: str) -> Rule:
    """Points per hit with one reason per position; ``count`` is the cheap total."""

    def entries() -> Column:
        return F.transform(
            F.filter(F.sequence(F.lit(first), last), hit_at),
            lambda p: _entry(F.replace(F.lit(reason), F.lit("{p}"), p.cast("string")), F.lit(float(points))),
        )

    return Rule(count * F.lit(float(points)), _listed(count > 0, entries))


#: What the rules count: name -> (strands, letters, first place, last place), in the strands ...
_COUNTS = {
    "ps": ("both", "S", 1, None),
    "ps_guide_start": ("antisense", "S", 1, 2),
    "ps_guide_end": ("antisense", "S", 21, 22),
    "ps_sense_start": ("sense", "S", 1, 2),
    "ribose": ("both", K.RIBOSE_SYMBOLS, 1, None),
    "methyl": ("both", "M", 1, None),
    "conjugates": ("both", "4", 1, None),
    "exotic": ("antisense", K.EXOTIC_SYMBOLS, 1, None),
    "benzyl": ("antisense", "B", 1, None),
    "inosine": ("antisense", "J", 1, None),
}
#: ... and in the exposure strings.
_OPEN_COUNTS = {
    "u_seed": ("antisense", "U", 2, 8),
    "u_tail": ("antisense", "U", 9, None),
    "u_sense": ("sense", "U", 1, None),
    "seed_covered": ("antisense", COVERED + FLUORO_PYRIMIDINE, 2, 8),
    "fluoro": ("antisense", FLUORO_PYRIMIDINE, 1, None),
}
#: Single places: name -> (column, place).
_PLACES = {
    "guide_1": ("antisense", 1),
    "guide_7": ("antisense", 7),
    "guide_21": ("antisense", 21),
    "open_guide_7": ("open_antisense", 7),
    "sense_1": ("sense", 1),
    "sense_21": ("sense", 21),
}

Reading = dict[str, Column]


def read_strands() -> Reading:
    """What the rules read of a variant, taken from its strands."""

    def counted(column: str, letters: str, first: int, last: int | None) -> Column:
        s = F.col(column)
        if last is not None:
            s = F.substring(s, first, last - first + 1)
        elif first > 1:
            s = F.substr(s, F.lit(first))
        return count_of(s, letters) if len(letters) == 1 else count_in(s, letters)

    def in_strands(prefix: str, strands: str, *where) -> Column:
        each = ["sense", "antisense"] if strands == "both" else [strands]
        return _sum([counted(prefix + x, *where) for x in each])

    guide, parent = F.col("antisense"), F.col("parent_antisense")
    return {
        **{name: in_strands("", *where) for name, where in _COUNTS.items()},
        **{name: in_strands("open_", *where) for name, where in _OPEN_COUNTS.items()},
        **{name: _char(*where) for name, where in _PLACES.items()},
        "guide_points": _sum(
            [count_of(F.substring(guide, a, b - a + 1), x) * F.lit(float(n)) for a, b, x, n, _ in K.GUIDE_POSITION_RULES]
        ),
        "motifs": _sum(motif_hits(F.concat("open_sense", "open_antisense"))),
        "modified": guide != parent,
        "pyrimidines": count_of(parent, "U") + count_of(parent, "C"),
        "guide_long": F.length(guide) > 20,
        "sense_long": F.length("sense") > 20,
    }


def motifs_left(before: Column, exposed: Column) -> Column:
    """Motif hits of both exposure strings, searched only where there were some ``before``
    a place was covered: that makes none."""
    return F.when(before == 0, F.lit(0)).otherwise(_sum(motif_hits(exposed)))


def read_replaced(
    before: Reading, symbol: Column, at: Column, on_guide: Column, old: Column, old_mark: Column, base: Column, motifs: Column
) -> Reading:
    """``before``, the reading of a duplex, once ``symbol`` stands at place ``at`` of a strand.

    ``old`` and ``old_mark`` are what stood there in the strand and in its exposure string,
    ``base`` is the parent's; ``motifs`` are the motif hits afterwards.
    """
    mark = exposure_mark(symbol, base)

    def moved(name: str, new: Column, gone: Column, strands: str, letters: str, first: int, last: int | None) -> Column:
        change = new.isin(*letters).cast("int") - gone.isin(*letters).cast("int")
        inside = [] if strands == "both" else [on_guide if strands == "antisense" else ~on_guide]
        if first > 1:
            inside.append(at >= first)
        if last is not None:
            inside.append(at <= last)
        if inside:
            change = F.when(reduce(lambda a, b: a & b, inside), change).otherwise(0)
        return before[name] + change

    def placed(name: str, column: str, place: int) -> Column:
        here = ~on_guide if column == "sense" else on_guide
        return F.when(here & (at == place), mark if column.startswith("open_") else symbol).otherwise(before[name])

    def points(letter: Column) -> Column:
        chain = F
        for first, last, x, n, _ in K.GUIDE_POSITION_RULES:
            chain = chain.when((letter == x) & at.between(first, last), F.lit(float(n)))
        return chain.otherwise(F.lit(0.0))

    return {
        **before,
        **{name: moved(name, symbol, old, *where) for name, where in _COUNTS.items()},
        **{name: moved(name, mark, old_mark, *where) for name, where in _OPEN_COUNTS.items()},
        **{name: placed(name, *where) for name, where in _PLACES.items()},
        "guide_points": before["guide_points"] + F.when(on_guide, points(symbol) - points(old)).otherwise(F.lit(0.0)),
        "motifs": motifs,
        "modified": before["modified"] | (on_guide & (symbol != base)),
    }


def with_reading(duplexes: DataFrame) -> DataFrame:
    """Add what the rules read as columns, which ``carried_reading`` names."""
    return duplexes.withColumns({f"_read_{name}": value for name, value in read_strands().items()})


def carried_reading() -> Reading:
    return {name: F.col(f"_read_{name}") for name in read_strands()}


def _holds(strand: Column, symbol: str):
    return lambda p: F.substr(strand, p, F.lit(1)) == symbol


def nuclease_rules(r: Reading) -> list[Rule]:
    ps = r["ps"]
    guide_ends = r["ps_guide_start"] + r["ps_guide_end"]
    sense_ends = r["ps_sense_start"]
    density = r["ribose"] / F.lit(42.0)
    return [
        _flag(ps == 0, 5, K.REASON_NO_PS),
        _flag((ps > 0) & (ps < 3), 3, K.REASON_FEW_PS),
        _flag((ps >= 3) & (guide_ends < 2), 2, K.REASON_AS_PS),
        _flag((ps >= 3) & (sense_ends < 1), 1, K.REASON_SS_PS),
        _flag(density < 0.2, 4, K.REASON_LOW_DENSITY),
        _flag((density >= 0.2) & (density < 0.4), 2, K.REASON_SUB_DENSITY),
    ]


def motif_hits(exposed: Column) -> list[Column]:
    """Hits per motif in motif order; letters inside a hit are hidden from later motifs.

    Overlapping hits of one motif all count, and their union is hidden: a chain of
    overlapping GUUGU is GU(UGU)+, one of GUGU is GU repeated.
    """
    longest, middle, shortest = K.PENALTY_MOTIFS

    def hidden(text: Column, motif: str, chain: str) -> Column:
        return F.when(F.contains(text, F.lit(motif)), F.regexp_replace(text, chain, COVERED)).otherwise(text)

    def hits(text: Column, motif: str) -> Column:
        return F.when(F.contains(text, F.lit(motif)), overlapping_count(text, motif)).otherwise(F.lit(0))

    after_longest = hidden(exposed, longest, "GU(?:UGU)+")
    after_middle = hidden(after_longest, middle, "(?:GU){2,}")
    # two overlapping UGU would hold a GUGU, so those left stand apart
    left = F.length(after_middle) - F.length(F.replace(after_middle, F.lit(shortest), F.lit("")))
    return [
        hits(exposed, longest),
        hits(after_longest, middle),
        (left / len(shortest)).cast("int"),
    ]


def immuno_rules(r: Reading) -> list[Rule]:
    open_guide, open_sense = F.col("open_antisense"), F.col("open_sense")

    def uridine(count: Column, strand: Column, first: int, last: Column, points: float, reason: str) -> Rule:
        return _placed(count, lambda p: F.substr(strand, p, F.lit(1)) == "U", first, last, points, reason)

    def motifs() -> Column:
        found = motif_hits(F.concat(open_sense, open_guide))
        texts = [F.lit(K.REASON_MOTIF.replace("{m}", name)) for name in K.PENALTY_MOTIFS]
        return F.concat(*[_listed(n > 0, lambda: F.array(_entry(t, n * F.lit(3.0))))() for t, n in zip(texts, found)])

    return [
        uridine(r["u_seed"], open_guide, 2, F.lit(8), 2, K.REASON_U_SEED),
        uridine(r["u_tail"], open_guide, 9, F.greatest(F.length(open_guide), F.lit(9)), 0.5, K.REASON_U_TAIL),
        uridine(r["u_sense"], open_sense, 1, F.greatest(F.length(open_sense), F.lit(1)), 1, K.REASON_U_SENSE),
        Rule(r["motifs"] * F.lit(3.0), motifs),
        _flag(r["methyl"] > 24, 4, K.REASON_OVER_METHYLATED),
    ]


def risc_rules(r: Reading) -> list[Rule]:
    guide, first = F.col("antisense"), r["guide_1"]
    exempt = ((r["guide_7"] == "6") & (r["open_guide_7"] == COVERED)).cast("int")
    seed_mods = r["seed_covered"] - exempt
    modified = r["modified"]  # half of a scan leaves the guide alone

    def at_places() -> Column:
        listed = []
        for a, b, symbol, points, reason in K.GUIDE_POSITION_RULES:
            hits = F.when(modified, count_of(F.substring(guide, a, b - a + 1), symbol)).otherwise(F.lit(0))
            listed.append(_placed(hits, _holds(guide, symbol), a, F.lit(b), points, reason).reasons())
        return F.concat(*listed)

    share = F.when(r["pyrimidines"] > 0, r["fluoro"] / r["pyrimidines"])
    exotic = F.when(modified, r["exotic"]).otherwise(F.lit(0))
    return [
        _flag(first != "1", 5, K.REASON_NO_PHOSPHATE),
        _flag(first == "S", 2, K.REASON_PS_FIRST),
        _counted(seed_mods, 2, K.REASON_SEED_MODS, "{n}"),
        _flag(first == "L", 8, K.REASON_LNA_FIRST),
        Rule(F.when(modified, r["guide_points"]).otherwise(F.lit(0.0)), at_places),
        _flag(share < 0.2, 6, K.REASON_LOW_F),
        _flag((share >= 0.2) & (share < 0.4), 3, K.REASON_SUB_F),
        _counted(exotic, 1, K.REASON_EXOTIC, "{n}"),
        _flag(r["benzyl"] > 0, 1, K.REASON_BENZYL),
        _flag(r["inosine"] > 0, 1, K.REASON_INOSINE),
    ]


def thermo_rules(sense: str = "parent_sense", antisense: str = "parent_antisense") -> list[Rule]:
    """Depend on the parent only."""
    base = F.upper(F.col(sense))
    gc = gc_percent(base)
    shown = F.format_string("%.1f", F.bround(gc, 1))
    extreme = (gc < 30.0) | (gc > 65.0)
    return [
        _flag(extreme, 8, F.replace(F.lit(K.REASON_EXTREME_GC), F.lit("{gc}"), shown)),
        _flag(
            ~extreme & ((gc < 35.0) | (gc > 55.0)), 3, F.replace(F.lit(K.REASON_SUB_GC), F.lit("{gc}"), shown)
        ),
        _flag(has_palindrome(base), 5, K.REASON_PALINDROME),
        _flag(has_homopolymer(base), 5, K.REASON_HOMOPOLYMER),
        _flag(~F.upper(_char(antisense, 1)).isin("A", "U"), 4, K.REASON_GUIDE_START),
        _flag((F.length(base) >= 19) & ~_char(base, 19).isin("G", "C"), 3, K.REASON_SENSE_19),
        _flag(has_gc_run(base), 3, K.REASON_GC_BLOCK),
    ]


def serum_rules(r: Reading) -> list[Rule]:
    first, last, sense_first, sense_last = (r[x] for x in ("guide_1", "guide_21", "sense_1", "sense_21"))
    single = (r["conjugates"] == 1) & (sense_first == "4")
    return [
        _flag(first == "4", 40, K.REASON_AS_CONJUGATE),
        _flag(first.isin("A", "U", "C", "G", "4"), 4, K.REASON_AS5_OPEN),
        _flag(r["guide_long"] & ~last.isin("S", "1"), 3, K.REASON_AS3_OPEN),
        _flag(~sense_first.isin("S", "4"), 3, K.REASON_SS5_OPEN),
        _flag(r["sense_long"] & ~sense_last.isin("S", "4"), 2, K.REASON_SS3_OPEN),
        _flag(single, 3, K.REASON_SINGLE_CONJUGATE),
        _flag(~single & (sense_first == "4") & (sense_last == "4"), -5, K.REASON_DUAL_CONJUGATE),
    ]


# domain -> (rules, lower bound, upper bound)
_DOMAIN_RULES = {
    "nuclease": (nuclease_rules, None, 20.0),
    "immuno": (immuno_rules, None, 28.0),
    "risc": (risc_rules, -10.0, 60.0),
    "thermo": (lambda _: thermo_rules(), None, 20.0),
    "serum": (serum_rules, -5.0, 60.0),
}


def penalty_total(domain: str, reading: Reading | None = None) -> Column:
    rules, low, high = _DOMAIN_RULES[domain]
    total = F.least(_sum([r.points for r in rules(reading or read_strands())]), F.lit(high))
    return total if low is None else F.greatest(total, F.lit(low))


def penalty_details(domain: str) -> Column:
    """Map of reason to points for the rules that apply."""
    rules = _DOMAIN_RULES[domain][0]
    return F.map_from_entries(F.concat(*[r.reasons() for r in rules(read_strands())]))


def with_thermo(parents: DataFrame) -> DataFrame:
    """Thermo penalty of parents; taken before variants are expanded, so that it is
    computed once per parent."""
    total = F.least(_sum([r.points for r in thermo_rules("sense", "antisense")]), F.lit(20.0))
    return parents.withColumn("thermo", total)


def with_penalties(variants: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Add one total per domain; a ``thermo`` column carried over is kept."""
    wanted = [d for d in (domains or DOMAINS) if d not in variants.columns]
    return variants.withColumns({d: penalty_total(d) for d in wanted})


#: Letters that the rules of a domain tell apart in a replaced place: those of one string
#: count alike, and so do all that are not listed.
_READ = {
    "nuclease": ["S", K.RIBOSE_SYMBOLS],
    "immuno": [],  # one methyl is never too many, and a covered place is a covered place
    "risc": list(dict.fromkeys(["F", "1", "S", "6", "B", "J", *[r[2] for r in K.GUIDE_POSITION_RULES]])),
    "serum": ["4", "S", "1"],
}
_READ["risc"].append("".join(x for x in K.EXOTIC_SYMBOLS if x not in _READ["risc"]))


def symbols_alike(domain: str, symbols: list[str]) -> dict[str, list[str]]:
    """First symbol of every set that the rules of ``domain`` do not tell apart -> the set."""
    sets: dict[int, list[str]] = {}
    for symbol in symbols:
        at = next((i for i, letters in enumerate(_READ[domain]) if symbol in letters), -1)
        sets.setdefault(at, []).append(symbol)
    return {alike[0]: alike for alike in sets.values()}


def cells_alike(domain: str, cells: DataFrame) -> DataFrame:
    """Strands that get the same penalty with ``mod_position`` of ``mod_strand`` replaced
    become the same strands; ``n`` counts them. For parents of A, U, G, C and T.

    No rule but those of motifs reads which bases stand where: they count pyrimidines of
    the guide (risc), look at the ends (serum) or at replaced places only (nuclease).
    """
    same = ["mod_strand", "mod_position"]
    sense, guide, at = F.col("sense"), F.col("antisense"), F.col("mod_position")
    if domain == "immuno":
        return cells.select(*same, "sense", "antisense", F.lit(1).cast("bigint").alias("n"))
    if domain == "risc":
        here = F.when(F.col("mod_strand") == "antisense", F.substr(guide, at, F.lit(1))).otherwise(F.lit("A"))
        base = F.when(here.isin("U", "C"), F.lit("U")).otherwise(F.lit("A"))
        others = count_in(guide, "UC") - F.when(base == "U", 1).otherwise(0)
        key = cells.select(*same, F.length(sense).alias("_s"), F.length(guide).alias("_a"), base.alias("_base"), others.alias("_others"))
        counted = key.groupBy(*key.columns).agg(F.count(F.lit(1)).alias("n"))
        rest = F.rpad(F.repeat(F.lit("U"), F.col("_others")), F.col("_a") - F.length("_base"), F.lit("A"))
        on_guide = F.concat(F.substr(rest, F.lit(1), at - 1), F.col("_base"), F.substr(rest, at))
        whole = F.rpad(F.repeat(F.lit("U"), F.col("_others")), F.col("_a"), F.lit("A"))
        return counted.select(
            *same,
            F.repeat(F.lit("A"), F.col("_s")).alias("sense"),
            F.when(F.col("mod_strand") == "antisense", on_guide).otherwise(whole).alias("antisense"),
            "n",
        )
    bases = "AUGC" if domain == "serum" else "AUGCT"
    key = [F.translate(c, bases, "A" * len(bases)).alias(c) for c in ("sense", "antisense")]
    return cells.select(*same, *key).groupBy(*same, "sense", "antisense").agg(F.count(F.lit(1)).alias("n"))


def penalty_sum() -> Column:
    return _sum([F.col(d) for d in DOMAINS])


def adjusted_efficacy(raw: Column, penalty: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw - F.lit(K.PENALTY_SCALE) * penalty))


def raw_from_adjusted(adjusted: Column, penalty: Column) -> Column:
    """Score before penalties, recomputed from the adjusted one."""
    return adjusted + F.lit(K.PENALTY_SCALE) * penalty


def with_adjusted(variants: DataFrame, raw: str, name: str = "efficacy_score") -> DataFrame:
    """Add all penalty totals, their sum and the adjusted efficacy."""
    scored = with_penalties(variants).withColumn("penalty_sum", penalty_sum())
    return scored.withColumn(name, adjusted_efficacy(F.col(raw), F.col("penalty_sum")))


def breakdown() -> Column:
    """Struct of {total, details} per domain; expects the totals as columns."""
    return F.struct(
        *[F.struct(F.col(d).alias("total"), penalty_details(d).alias("details")).alias(d) for d in DOMAINS]
    )


def composite_score(efficacy: Column, nuclease: Column, immuno: Column, risc: Column, thermo: Column) -> Column:
    """Legacy tie-break score; every input is on a 0-100 scale."""
    weights = [(efficacy, 0.50), (nuclease, 0.12), (immuno, 0.12), (risc, 0.12), (thermo, 0.14)]
    return _sum([F.lit(w) * (c / F.lit(100.0)) for c, w in weights]) * F.lit(100.0)
