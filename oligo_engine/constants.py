"""Alphabets, lookup tables, thresholds and report texts.

Everything here is domain data that results depend on literally.  Logic lives in
``functions`` and ``operators``.
"""

from __future__ import annotations

# --- Fixed values: alphabet -------------------------------------------------
STRAND_LENGTH = 21
CANONICAL = ["A", "U", "G", "C", "T"]
# (symbol, name, part of the nucleotide); the six-bit code of a symbol is its
# 1-based place in this list.
SYMBOLS = [
    ("A", "Adenosine (canonical)", "canonical"),
    ("U", "Uridine (canonical)", "canonical"),
    ("G", "Guanosine (canonical)", "canonical"),
    ("C", "Cytidine (canonical)", "canonical"),
    ("T", "Thymidine (canonical DNA)", "canonical"),
    ("F", "2'-Fluoro", "sugar"),
    ("M", "2'-O-Methyl (2'-OMe)", "sugar"),
    ("L", "Locked Nucleic Acid (LNA)", "sugar"),
    ("D", "2'-Deoxy (DNA)", "sugar"),
    ("E", "2'-O-Methoxyethyl (2'-MOE)", "sugar"),
    ("B", "2'-O-Benzyl", "sugar"),
    ("N", "4'-thio", "sugar"),
    ("I", "2'-F-ANA (FANA)", "sugar"),
    ("Z", "2'-OMe-4'-thio", "sugar"),
    ("Y", "ENA (2'-O,4'-C-Ethylene)", "sugar"),
    ("X", "2'-O-allyl", "sugar"),
    ("Q", "Abasic", "sugar"),
    ("S", "Phosphorothioate (PS)", "backbone"),
    ("P", "Boranophosphate", "backbone"),
    ("R", "Methylphosphonate", "backbone"),
    ("H", "Phosphoramidate", "backbone"),
    ("V", "5-Methyl Cytidine (m5C)", "base"),
    ("W", "Pseudouridine", "base"),
    ("J", "Inosine", "base"),
    ("K", "2-thio Uridine", "base"),
    ("O", "Dihydrouridine", "base"),
    ("1", "5'-Phosphate", "terminus"),
    ("2", "3'-Phosphate", "terminus"),
    ("3", "5'-OMe cap", "terminus"),
    ("4", "Cholesterol conjugate", "conjugate"),
    ("5", "PEG conjugate", "conjugate"),
    ("6", "UNA (Unlocked Nucleic Acid)", "sugar"),
    ("7", "ANA (Arabinonucleic Acid)", "sugar"),
    ("8", "GNA (Glycol Nucleic Acid)", "sugar"),
    ("9", "TNA (Threose Nucleic Acid)", "sugar"),
]
MODIFICATIONS = [symbol for symbol, _, kind in SYMBOLS if kind != "canonical"]

# --- Fixed values: modification-name aliases, first match wins ---------------
ALIAS_RULES = [
    ("unlocked nucleic acid", "6"),
    ("alfa-l-locked nucleic acid", "L"),
    ("locked nucleic acid", "L"),
    ("2-o-methyl", "M"),
    ("2-deoxy-2-fluoro", "F"),
    ("2-fluoro", "F"),
    ("2-deoxy", "D"),
    ("glycol nucleic acid", "8"),
    ("threose nucleic acid", "9"),
    ("hexitol nucleic acid", "7"),
    ("altritol nucleic acid", "Y"),
    ("arabino", "I"),
    ("methoxyethyl", "E"),
    ("reverse deoxy", "D"),
    ("2-o-hexadecyl", "X"),
    ("2-o-benzyl", "B"),
    ("4-thio", "N"),
    ("pseudouridine", "W"),
    ("methylcytidine", "V"),
    ("inosine", "J"),
    ("abasic", "Q"),
    ("galactosamine", "4"),
    ("galnac", "4"),
    ("cholesterol", "4"),
    ("vinyl phosphonate", "3"),
    ("5-phosphate", "1"),
    ("3-phosphate", "2"),
    ("phosphate", "2"),
    ("methylphosphonate", "R"),
    ("phosphoramidate", "H"),
    ("phosphorothioate", "S"),
]
UNMODIFIED_TOKENS = ["", "0", "nan", "none"]
UNMAPPABLE_AS_BLANK = ["", "0", "nan", "NaN"]
PRIME_MARKS = "'’`′"

# --- Fixed values: feature vocabulary ---------------------------------------
# Flag order inside one position of the modified-duplex feature vector.
FEATURE_FLAGS = [
    ("F", "2F"), ("M", "2OMe"), ("L", "LNA"), ("D", "DNA"), ("E", "MOE"),
    ("B", "Benzyl"), ("N", "4thio"), ("I", "FANA"), ("Z", "ZOMe"), ("Y", "ENA"),
    ("S", "PS"), ("P", "Borano"), ("R", "MePhos"), ("H", "PhosAmid"),
    ("V", "m5C"), ("W", "PseudoU"), ("J", "Inosine"), ("K", "2thioU"),
    ("O", "DihydroU"), ("1", "5Phos"), ("2", "3P"), ("3", "5OMe"), ("5", "PEG"),
    ("6", "UNA"), ("7", "ANA"), ("8", "GNA"), ("9", "TNA"), ("4", "Conj"),
    ("Q", "Abasic"), ("U", "ModU"), ("X", "ModX"),
]
FEATURE_BASES = "ACGU"
DEFAULT_DOSE_NM = 10.0

# --- Fixed values: scan grids ------------------------------------------------
MINI_SCAN_SYMBOLS = ["E", "D", "Q", "L"]
MINI_SCAN_POSITIONS = 10
BULKY_SYMBOLS = "LYE"

# --- Fixed values: thresholds and labels ------------------------------------
EFFICACY_BANDS = [(80.0, "Very High"), (70.0, "High"), (55.0, "Moderate")]
EFFICACY_FLOOR_LABEL = "Low"
PANEL_THRESHOLD = 60.0
VIABILITY_SAFE = 70.0
VIABILITY_CAUTION = 50.0
FUNCTIONAL_GC_RANGE = (30.0, 65.0)
PENALTY_SCALE = 0.7
PLATEAU_GAIN = 0.5
SAFETY_WEIGHT = 0.2
SAFETY_WARNING_BELOW = 80.0
OFFTARGET_K = 15
SEED_K = 6

# --- Fixed values: nearest-neighbour enthalpies, kcal/mol --------------------
# SantaLucia & Hicks 2004; unknown dinucleotides take the default.
NEAREST_NEIGHBOUR = [
    ("AA", -6.82), ("AU", -9.38), ("AC", -10.44), ("AG", -7.69),
    ("UA", -9.38), ("UU", -6.82), ("UC", -8.33), ("UG", -13.39),
    ("CA", -9.38), ("CU", -10.44), ("CC", -12.11), ("CG", -10.64),
    ("GA", -7.69), ("GU", -13.39), ("GC", -8.26), ("GG", -12.11),
]
NEAREST_NEIGHBOUR_DEFAULT = -8.0

# --- Fixed values: immune motifs ---------------------------------------------
PENALTY_MOTIFS = ["GUUGU", "GUGU", "UGU"]
SAFETY_MOTIFS = ["GUUGU", "GUGU", "UGU", "UUG", "UGGC", "GUUC"]

# --- Fixed values: positional guide-strand weights ---------------------------
# (first position, last position, symbol, weight per hit, reason; {p} = position)
GUIDE_POSITION_RULES = [
    (2, 4, "L", 5.0, "LNA in early seed (pos {p})"),
    (10, 10, "L", 3.0, "LNA at catalytic cleft (AS pos {p}, Elmén 2005)"),
    (12, 12, "L", 3.0, "LNA at catalytic cleft (AS pos {p}, Elmén 2005)"),
    (14, 14, "L", 3.0, "LNA at catalytic cleft (AS pos {p}, Elmén 2005)"),
    (3, 12, "E", 3.0, "MOE in catalytic cleft (pos {p})"),
    (2, 5, "8", 4.0, "GNA in early seed (pos {p})"),
    (6, 8, "8", -2.0, "GNA in late seed (therap. bonus) (pos {p})"),
    (2, 8, "Y", 4.0, "ENA in seed (pos {p})"),
    (9, 14, "Y", 2.0, "ENA over-stabilization (pos {p})"),
    (2, 6, "9", 3.0, "TNA in seed (pos {p})"),
    (8, 14, "9", 1.0, "TNA in body (pos {p})"),
]
EXOTIC_SYMBOLS = "BJVINOPRHKZQWX7"
RIBOSE_SYMBOLS = "FMLEBD"
STANDARD_CHEMISTRY = "MFS1LED"

# --- Fixed values: penalty reasons -------------------------------------------
REASON_NO_PS = "Lack of PS backbone"
REASON_FEW_PS = "Insufficient PS backbone (<3)"
REASON_AS_PS = "AS terminal PS coverage suboptimal (<2 at pos 0,1,20,21)"
REASON_SS_PS = "Sense terminal PS missing (pos 0 or 1)"
REASON_LOW_DENSITY = "Low 2'-mod density (<20%)"
REASON_SUB_DENSITY = "Suboptimal 2'-mod density (<40%)"
REASON_U_SEED = "Unmodified U in AS seed (pos {p})"
REASON_U_TAIL = "Unmodified U in AS tail (pos {p})"
REASON_U_SENSE = "Unmodified U in Sense (pos {p})"
REASON_MOTIF = "Unmasked TLR motif '{m}'"
REASON_OVER_METHYLATED = "Extreme 2'-OMe saturation (>24)"
REASON_NO_PHOSPHATE = "Missing 5'-phosphate anchor"
REASON_PS_FIRST = "PS at position 1 (distorts pocket)"
REASON_SEED_MODS = "Bulky seed modifications ({n})"
REASON_LNA_FIRST = "LNA at AS 5' pos (abolishes activity, Elmén 2005)"
REASON_LOW_F = "Low 2'-F pyrimidine coverage (<20%)"
REASON_SUB_F = "Suboptimal 2'-F pyrimidine coverage (<40%)"
REASON_EXOTIC = "Exotic modifications ({n})"
REASON_BENZYL = "B modification penalty"
REASON_INOSINE = "J modification penalty"
REASON_EXTREME_GC = "Extreme GC Content ({gc}%)"
REASON_SUB_GC = "Suboptimal GC Content ({gc}%)"
REASON_PALINDROME = "Internal Palindrome detected"
REASON_HOMOPOLYMER = "Homopolymer run detected"
REASON_GUIDE_START = "Guide 5' not A/U (poor Ago2 loading)"
REASON_SENSE_19 = "Sense 3' pos 19 not G/C (asymmetry flaw)"
REASON_GC_BLOCK = "GC-heavy block detected (6+)"
REASON_AS_CONJUGATE = "FATAL: GalNAc at AS 5' end abolishes activity (Weingärtner 2020)"
REASON_AS5_OPEN = "Unprotected AS 5' terminus"
REASON_AS3_OPEN = "Unprotected AS 3' terminus"
REASON_SS5_OPEN = "Unprotected Sense 5' terminus"
REASON_SS3_OPEN = "Unprotected Sense 3' terminus"
REASON_SINGLE_CONJUGATE = "Single GalNAc only — reduced in vivo potency (Weingärtner 2020)"
REASON_DUAL_CONJUGATE = (
    "Dual-terminal Sense GalNAc bonus (3-4x potency, Weingärtner 2020)"
)

# --- Fixed values: functional-filter reasons ---------------------------------
FUNC_GC = "GC {gc}% out of optimal 30-65% range"
FUNC_HOMOPOLYMER = "5-base homopolymer run detected (prevents unwinding)"
FUNC_GC_RUN = "6-base contiguous GC run detected"
FUNC_PALINDROME = "Internal palindrome detected (forms stable hairpins)"

# --- Fixed values: seed rescue -----------------------------------------------
RESCUE_NAMES = [("M", "2'-OMe"), ("F", "2'-Fluoro"), ("L", "LNA"), ("E", "2'-MOE")]
RESCUE_PREFIX = "Seed off-target rescue: "

# --- Fixed values: safety report texts ---------------------------------------
RISK_ASYMMETRY = (
    "WARNING: Thermodynamic asymmetry favors Sense Strand loading (Score: {x}). "
    "High risk of Sense-Strand-mediated off-targets."
)
NOTE_GUIDE_START = (
    "Note: Antisense 5' end is not A or U. This is sub-optimal for Ago2 "
    "MID-domain anchoring."
)
RISK_CRITICAL = (
    "CRITICAL: 15-mer contiguous match detected in Human Transcriptome. "
    "This guarantees off-target transcript cleavage."
)
NOTE_SEED_M2 = "Position 2 contains 2'-OMe, mitigating off-target seed binding."
NOTE_SEED_7 = (
    "Position 7 contains a steric modification (e.g. 2'-diol), mitigating "
    "seed-based off-targets."
)
NOTE_SEED_MITIGATED = (
    "Seed region has {n} matches, but risk is MITIGATED by chemical modification."
)
RISK_SEED = (
    "Seed region ({seed}) matched {n} times in human transcriptome without mitigation."
)
RISK_MOTIF = (
    "WARNING: Unmasked TLR7/8 motif ({m}) found in {strand} strand. "
    "High risk of innate immune activation (Interferon response)."
)
NOTE_MOTIF = "TLR7/8 motif ({m}) in {strand} strand is safely masked by 2'-OMe."
RISK_CONJUGATE = (
    "WARNING: Missing GalNAc ('4') delivery conjugate. Predicted hepatic uptake is 0%. "
    "In vivo pharmacokinetic profile will fail."
)
NOTE_CONJUGATE = (
    "GalNAc ('4') conjugate detected. Hepatic uptake and PK profile validated."
)
CERTIFICATE_TITLE = "# Certificate of Biological Safety"
CERTIFICATE_SUBTITLE = "**Human RNAi Therapeutics Off-Target Scan**"
CERTIFICATE_FOOTER = (
    "*Validated checks include: Thermodynamic Asymmetry end-loading preference, "
    "Slicer-mediated 15-mer exclusion, and Seed-region mismatch mitigation against the "
    "GRCh38 Human Transcriptome.*"
)

# --- Fixed values: gradient-boosting settings --------------------------------
# Published settings and the closest Spark ML parameter of each.
GBT_STEP_SIZE = 0.03
GBT_MAX_DEPTH = 7
GBT_MAX_ITER = 3000
GBT_PATIENCE = 100
GBT_SUBSAMPLING = 0.8
GBT_FEATURE_FRACTION = "0.6"
GBT_MIN_INSTANCES = 20
GBT_SEED = 42
