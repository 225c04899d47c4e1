"""SQL building blocks for the DuckDB side of the registered queries.

Written from the rule tables independently of the Spark expressions: positions are
listed and tested one at a time.
"""

from __future__ import annotations

from oligo_engine import constants as K

SYMBOL_LIST = "[" + ",".join(f"'{s}'" for s in K.MODIFICATIONS) + "]"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def bases(text: str) -> str:
    return f"translate(md5({text}), '0123456789abcdef', 'AUGCAUGCAUGCAUGC')"


def long_bases(text: str, pieces: int = 8) -> str:
    return "concat(" + ", ".join(bases(f"concat({text}, '#{i}')") for i in range(pieces)) + ")"


def revcomp(s: str) -> str:
    return f"reverse(translate({s}, 'AUGC', 'UACG'))"


TRANSCRIPTS = f"transcripts AS (SELECT doc_id AS transcript_id, {long_bases('text')} AS sequence FROM documents)"
TRANSCRIPTOME = (
    f"transcriptome AS (SELECT page_id AS record_id, {long_bases('html')} AS sequence FROM pages "
    "UNION ALL SELECT transcript_id + 1000000000, sequence FROM transcripts WHERE transcript_id % 50 = 0)"
)
PARENTS = (
    "parents AS (SELECT parent_id, sense, " + revcomp("sense") + " AS antisense FROM (SELECT p_partkey AS parent_id, substr("
    + bases("p_partkey::VARCHAR") + ", 1, 21) AS sense FROM part))"
)
SEEDS = (
    "seed_viability AS (SELECT seed, ((instr('0123456789abcdef', substr(md5(seed),1,1)) - 1) * 16 + "
    "(instr('0123456789abcdef', substr(md5(seed),2,1)) - 1)) * 100e0 / 255e0 AS viability "
    "FROM (SELECT DISTINCT substr(" + bases("o_orderkey::VARCHAR") + ", 1, 6) AS seed FROM orders) "
    "WHERE NOT starts_with(md5(seed), '0'))"
)
TILES = (
    "tiles AS (SELECT transcript_id, position, sense, " + revcomp("sense") + " AS antisense FROM "
    "(SELECT transcript_id, p::INTEGER AS position, substr(sequence, p + 1, 21) AS sense FROM "
    "(SELECT transcript_id, sequence, unnest(range(0, length(sequence) - 20)) AS p FROM transcripts)))"
)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def count_of(s: str, char: str) -> str:
    return f"(length({s}) - length(replace({s}, '{char}', '')))"


def count_in(s: str, chars: str) -> str:
    return f"(length({s}) - length(translate({s}, '{chars}', '')))"


def gc_percent(s: str) -> str:
    return f"(CASE WHEN length({s}) = 0 THEN 0e0 ELSE {count_in(s, 'GC')} / length({s}) * 100e0 END)"


def palindrome(s: str) -> str:
    rc = revcomp(f"substr({s}, i, 4)")
    return f"(len(list_filter(range(1, length({s}) - 6), lambda i: instr(substr({s}, i + 4), {rc}) > 0)) > 0)"


def homopolymer(s: str) -> str:
    return f"regexp_matches({s}, 'AAAAA|UUUUU|GGGGG|CCCCC')"


def gc_run(s: str) -> str:
    return f"regexp_matches({s}, '[GC]{{6}}')"


def functional_reason(s: str) -> str:
    gc = gc_percent(s)
    return (
        f"(CASE WHEN {gc} < 30 OR {gc} > 65 THEN concat('GC ', round_even({gc}, 0)::INTEGER::VARCHAR, '% out of optimal 30-65% range') "
        f"WHEN {homopolymer(s)} THEN {quote(K.FUNC_HOMOPOLYMER)} WHEN {gc_run(s)} THEN {quote(K.FUNC_GC_RUN)} "
        f"WHEN {palindrome(s)} THEN {quote(K.FUNC_PALINDROME)} END)"
    )


def viability_label(v: str) -> str:
    return f"(CASE WHEN {v} IS NULL THEN 'Unknown' WHEN {v} >= 70 THEN 'Safe' WHEN {v} >= 50 THEN 'Caution' ELSE 'Toxic' END)"


def efficacy_label(v: str) -> str:
    return f"(CASE WHEN {v} >= 80 THEN 'Very High' WHEN {v} >= 70 THEN 'High' WHEN {v} >= 55 THEN 'Moderate' ELSE 'Low' END)"


def energy(s: str) -> str:
    table = "MAP {" + ", ".join(f"'{k}': {v}e0" for k, v in K.NEAREST_NEIGHBOUR) + "}"
    steps = [f"coalesce({table}[substr({s}, {i}, 2)], -8e0)" for i in (1, 2, 3)]
    return "(" + " + ".join(steps) + ")"


def clip(x: str) -> str:
    return f"least(100e0, greatest(0e0, {x}))"


def naked_score(sense: str = "sense", guide: str = "antisense") -> str:
    return clip(
        f"30e0 + 2e0 * {count_in(guide, 'AU')} - 1.5e0 * {count_of(f'substr({guide}, 2, 7)', 'G')} "
        f"+ (CASE WHEN left({guide}, 1) IN ('A','U') THEN 4e0 ELSE 0e0 END) + 0.25e0 * instr({sense}, 'GC')"
    )


def modified_score(s: str = "s", a: str = "a", pa: str = "pa") -> str:
    guide = [("M", 1.5), ("F", 2.0), ("S", 1.0), ("L", -2.25), ("D", 0.75), ("E", -0.5)]
    sense = [("S", 1.0), ("M", 0.75), ("F", 0.5)]
    terms = [f"88e0 + {count_in(pa, 'AU')}"]
    terms += [f"{w}e0 * {count_of(a, c)}" for c, w in guide]
    terms += [f"{w}e0 * {count_of(s, c)}" for c, w in sense]
    terms.append(f"(CASE WHEN left({a}, 1) = '1' THEN 3e0 ELSE 0e0 END)")
    return "(" + " + ".join(terms) + ")"


def rescale(raw: str, key: str) -> str:
    top = f"max({raw}) OVER (PARTITION BY {key})"
    return f"(CASE WHEN {top} > 100 THEN {raw} / {top} * 100e0 ELSE {clip(raw)} END)"


def _positions(first: int, last: str, test: str, weight: str) -> str:
    return f"coalesce(list_sum(list_transform(range({first}, {last} + 1), lambda i: CASE WHEN {test} THEN {weight} ELSE 0e0 END)), 0e0)"


def thermo(ps: str, pa: str) -> str:
    gc = gc_percent(ps)
    return (
        f"least(20e0, (CASE WHEN {gc} < 30 OR {gc} > 65 THEN 8e0 WHEN {gc} < 35 OR {gc} > 55 THEN 3e0 ELSE 0e0 END) "
        f"+ (CASE WHEN {palindrome(ps)} THEN 5e0 ELSE 0e0 END) + (CASE WHEN {homopolymer(ps)} THEN 5e0 ELSE 0e0 END) "
        f"+ (CASE WHEN left({pa}, 1) NOT IN ('A','U') THEN 4e0 ELSE 0e0 END) "
        f"+ (CASE WHEN length({ps}) >= 19 AND substr({ps}, 19, 1) NOT IN ('G','C') THEN 3e0 ELSE 0e0 END) "
        f"+ (CASE WHEN {gc_run(ps)} THEN 3e0 ELSE 0e0 END))"
    )


def nuclease() -> str:
    ps_count = count_of("m", "S")
    density = f"({count_in('m', 'FMLEBD')} / 42e0)"
    guide = "(" + " + ".join(f"(substr(a, {p}, 1) = 'S')::INTEGER" for p in (1, 2, 21, 22)) + ")"
    sense = "((substr(s, 1, 1) = 'S')::INTEGER + (substr(s, 2, 1) = 'S')::INTEGER)"
    return (
        f"least(20e0, (CASE WHEN {ps_count} = 0 THEN 5e0 WHEN {ps_count} < 3 THEN 3e0 ELSE "
        f"(CASE WHEN {guide} < 2 THEN 2e0 ELSE 0e0 END) + (CASE WHEN {sense} < 1 THEN 1e0 ELSE 0e0 END) END) "
        f"+ (CASE WHEN {density} < 0.2e0 THEN 4e0 WHEN {density} < 0.4e0 THEN 2e0 ELSE 0e0 END))"
    )


def immuno() -> str:
    def uridine(strand: str, parent: str) -> str:
        return f"substr({parent}, i, 1) = 'U' AND substr({strand}, i, 1) = 'U'"

    over = f"(CASE WHEN {count_of('m', 'M')} > 24 THEN 4e0 ELSE 0e0 END)"
    return (
        f"least(28e0, {_positions(2, '8', uridine('a', 'pa'), '2e0')} + {_positions(9, 'length(a)', uridine('a', 'pa'), '0.5e0')} "
        f"+ {_positions(1, 'length(s)', uridine('s', 'ps'), '1e0')} + 3e0 * (len(h1) + len(h2) + len(h3)) + {over})"
    )


def risc() -> str:
    seed = "substr(a, i, 1) <> substr(pa, i, 1) AND NOT (substr(a, i, 1) = '6' AND i = 7)"
    parts = [
        "(CASE WHEN left(a, 1) <> '1' THEN 5e0 ELSE 0e0 END)",
        "(CASE WHEN left(a, 1) = 'S' THEN 2e0 WHEN left(a, 1) = 'L' THEN 8e0 ELSE 0e0 END)",
        _positions(2, "8", seed, "2e0"),
    ]
    for first, last, symbol, weight, _ in K.GUIDE_POSITION_RULES:
        parts.append(f"{weight}e0 * {count_of(f'substr(a, {first}, {last - first + 1})', symbol)}")
    pyrimidines = count_in("pa", "UC")
    fluoro = _positions(1, "length(a)", "substr(a, i, 1) = 'F' AND contains('UC', substr(pa, i, 1))", "1e0")
    share = f"({fluoro} / {pyrimidines})"
    parts += [
        f"(CASE WHEN {pyrimidines} = 0 THEN 0e0 WHEN {share} < 0.2e0 THEN 6e0 WHEN {share} < 0.4e0 THEN 3e0 ELSE 0e0 END)",
        count_in("a", K.EXOTIC_SYMBOLS),
        "(CASE WHEN contains(a, 'B') THEN 1e0 ELSE 0e0 END)",
        "(CASE WHEN contains(a, 'J') THEN 1e0 ELSE 0e0 END)",
    ]
    return "least(60e0, greatest(-10e0, " + " + ".join(parts) + "))"


def serum() -> str:
    single = f"({count_of('m', '4')} = 1 AND left(s, 1) = '4')"
    return (
        "least(60e0, greatest(-5e0, (CASE WHEN left(a, 1) = '4' THEN 40e0 ELSE 0e0 END) "
        "+ (CASE WHEN contains('AUCG4', left(a, 1)) THEN 4e0 ELSE 0e0 END) "
        "+ (CASE WHEN substr(a, 21, 1) NOT IN ('S','1') THEN 3e0 ELSE 0e0 END) "
        "+ (CASE WHEN left(s, 1) NOT IN ('S','4') THEN 3e0 ELSE 0e0 END) "
        "+ (CASE WHEN substr(s, 21, 1) NOT IN ('S','4') THEN 2e0 ELSE 0e0 END) "
        f"+ (CASE WHEN {single} THEN 3e0 WHEN left(s, 1) = '4' AND substr(s, 21, 1) = '4' THEN -5e0 ELSE 0e0 END)))"
    )


def penalised(source: str, out: str, score: bool = True) -> str:
    """CTEs that add penalty totals to ``source`` (columns s, a, ps, pa).

    With ``score`` also the stand-in raw score.  Immune motif hits are found
    longest motif first; a later motif may not touch an earlier hit.
    """
    p = out
    raw = f", {modified_score()} AS raw" if score else ""

    def hits(motif: str, others: list[tuple[str, int]]) -> str:
        n = len(motif)
        free = "".join(
            f" AND len(list_filter({h}, lambda j: i <= j + {size - 1} AND j <= i + {n - 1})) = 0" for h, size in others
        )
        return (
            f"CASE WHEN NOT contains(m, '{motif}') THEN [] ELSE list_filter(range(1, length(c) - {n - 2}), "
            f"lambda i: substr(c, i, {n}) = '{motif}' AND substr(m, i, {n}) = '{motif}'{free}) END"
        )

    return ",\n".join(
        [
            f"{p}_0 AS (SELECT *, concat(ps, pa) AS c, concat(s, a) AS m{raw} FROM {source})",
            f"{p}_1 AS (SELECT *, {hits('GUUGU', [])} AS h1 FROM {p}_0)",
            f"{p}_2 AS (SELECT *, {hits('GUGU', [('h1', 5)])} AS h2 FROM {p}_1)",
            f"{p}_3 AS (SELECT *, {hits('UGU', [('h1', 5), ('h2', 4)])} AS h3 FROM {p}_2)",
            f"{p}_4 AS (SELECT *, {nuclease()} AS nuclease, {immuno()} AS immuno, {risc()} AS risc, "
            f"{thermo('ps', 'pa')} AS thermo, {serum()} AS serum FROM {p}_3)",
            f"{p} AS (SELECT * EXCLUDE (c, m, h1, h2, h3), nuclease + immuno + risc + thermo + serum AS penalty_sum FROM {p}_4)",
        ]
    )


def adjusted(raw: str, penalty: str = "penalty_sum") -> str:
    return clip(f"{raw} - 0.7e0 * {penalty}")


def put(strand: str, at: str, symbol: str) -> str:
    return f"concat(substr({strand}, 1, {at} - 1), {symbol}, substr({strand}, {at} + 1))"


def scan(source: str, out: str, symbols: str, strands: str, positions: int) -> str:
    """Single-modification grid over (parent_id, sense, antisense)."""
    return (
        f"{out} AS (SELECT parent_id, sym, strand, pos::INTEGER AS pos, "
        f"CASE WHEN strand = 'sense' THEN {put('sense', 'pos', 'sym')} ELSE sense END AS s, "
        f"CASE WHEN strand = 'antisense' THEN {put('antisense', 'pos', 'sym')} ELSE antisense END AS a, "
        f"sense AS ps, antisense AS pa FROM {source}, (SELECT unnest({symbols}) AS sym), "
        f"(SELECT unnest({strands}) AS strand), (SELECT unnest(range(1, {positions + 1})) AS pos))"
    )


MINI = ("['E','D','Q','L']", "['antisense']", 10)
FULL = (SYMBOL_LIST, "['sense','antisense']", 21)


def esc(source: str, out: str, plus: bool = False) -> str:
    """Clinical pattern over (parent_id, sense, antisense)."""
    guide = "concat('1S', translate(substr(antisense, 3, 17), 'UCAG', 'FFMM'), 'SS')"
    if plus:
        guide = f"concat(substr({guide}, 1, 6), '8', substr({guide}, 8))"
    return (
        f"{out} AS (SELECT parent_id, concat('SS', repeat('M', 18), '4') AS s, {guide} AS a, "
        f"sense AS ps, antisense AS pa FROM {source})"
    )


def micro(x: str) -> str:
    """Compare only six decimals of values whose last bits depend on summing order."""
    return f"floor({x} * 1e6 + 0.5e0)::BIGINT"


MEASURED = (
    "measured AS (SELECT row_id, sense, " + revcomp("sense") + " AS antisense, partkey, suppkey, linenumber, "
    "efficacy, prediction, source, target_gene, concentration_nM FROM (SELECT "
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INTEGER) AS row_id, substr("
    + bases("concat(l_orderkey::VARCHAR, '-', (l_linenumber % 3)::VARCHAR)")
    + ", 1, 21) AS sense, l_partkey AS partkey, l_suppkey AS suppkey, l_linenumber AS linenumber, "
    "l_quantity * 2e0 AS efficacy, floor(l_extendedprice / 1e3) AS prediction, l_returnflag AS source, "
    "CASE WHEN l_suppkey % 13 = 0 THEN 'Unknown' ELSE concat('gene', (l_suppkey % 13)::VARCHAR) END AS target_gene, "
    "nullif(l_discount * 100e0, 0e0) AS concentration_nM FROM lineitem))"
)
MODIFIED = (
    "modified AS (SELECT row_id, "
    + put("sense", "(1 + linenumber)", "'M'")
    + " AS s, "
    + put(put("antisense", "(2 + partkey % 19)", "'F'"), "(21 - suppkey % 5)", "'S'")
    + " AS a, sense AS ps, antisense AS pa, efficacy, prediction, source, target_gene, concentration_nM FROM measured)"
)
