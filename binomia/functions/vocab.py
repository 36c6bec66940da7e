"""Word lists and patterns that decide how names are read.

Patterns are Java regular expressions. ``(?U)`` makes ``\\w \\d \\s \\b`` follow
Unicode, ``(?iU)`` adds case folding.
"""

# ---------------------------------------------------------------------------
# They have to equal the published behaviour for equal results.
# ---------------------------------------------------------------------------

# Culture-collection prefixes; the order is the order of preference.
COLLECTION_PREFIXES = [
    "ATCC", "DSM", "JCM", "NCTC", "CCUG", "LMG", "CECT", "NRRL", "KCTC", "NBRC",
    "CIP", "APEC", "Nissle", "NJS", "CGMCC", "BCCM", "IFO", "IAM", "CBS", "MTCC",
    "KACC", "BCRC", "DSMZ", "NZCM", "WAL", "ETEC", "ABU", "ECC",
]

# Words that end a descriptive anchor.
CONTEXT_STOPS = [
    "strain", "isolate", "clone", "str", "str.", "of", "from", "in", "on", "associated",
    "host", "et", "al", "ex",
]

# Modifier + head pairs ("primary endosymbiont").
MODIFIERS = [
    "primary", "secondary", "facultative", "obligate", "obligatory",
    "intracellular", "extracellular",
]
HEADS = ["endosymbiont", "symbiont", "epibiont"]

# First words of anchors that describe instead of naming a genus.
DESCRIPTIVE_STARTS = [
    "uncultured", "unidentified", "unclassified", "unknown",
    "environmental", "candidate", "bacterium", "bacterial",
    "archaeon", "archaeal", "endosymbiont", "symbiont", "epibiont", "cyanobacterium",
]

# Words that close a descriptive anchor and belong to it.
DESCRIPTIVE_ENDS = ["bacterium", "archaeon", "organism", "cyanobacterium"]

# Nouns that look like code words but are places or hosts.
CONTEXT_NOUNS = [
    "lake", "river", "spring", "bay", "island", "islet", "mount", "mt", "valley", "forest",
    "host", "leaf", "root", "soil", "sediment", "gut", "mouse", "human", "epithemia", "turgida",
]

PLACEHOLDERS = ["sp", "spp"]

# Words never taken as a strain token.
STRAIN_STOPS = [
    "strain", "subsp", "ssp", "pv", "serovar", "biovar", "var", "variant", "sp", "genus",
    "species", "candidatus",
]

# Authorship notes.
AUTHOR_IN_PARENS = r"(?iU)\([^()]*\b(ex|et\s+al\.?)\b[^()]*\d{4}[^()]*\)"
AUTHOR_BARE = r"(?iU)\bex\s+[A-Z][a-z]+(?:\s+et\s+al\.?)?\s+\d{4}\b"
ANY_PARENS = r"(?U)\s*\([^)]*\)\s*"
BARE_EX_TAIL = r"(?iU)\s+\bex\b\s+.*$"
CANDIDATUS = r"(?iU)^\s*Candidatus\s+"
CANDIDATUS_QUOTED = r'(?iU)^\s*"?candidatus"?\s+'

# Ranks below species.
INFRASPECIFIC = (
    r"\b(subsp\.?|ssp\.?|subspecies|strain|pv\.?|pathovar|serovar|biovar|var\.?|variant|f\.?|forma)\b"
)
INFRASPECIFIC_PAIR = (
    r"(?iU)\b(subsp\.?|ssp\.?|subspecies|pv\.?|pathovar|serovar|biovar|var\.?|variant|f\.?|forma)"
    r"\s+([A-Za-z0-9_.-]+)\b"
)
INFRASPECIFIC_EPITHET = (
    r"\b(?:subsp(?:\.|ecies)?|pv\.?|pathovar|var\.?|variety|biovar|serovar)"
    r"\s+([A-Za-z][A-Za-z0-9-]*)\b"
)
SUBSPECIES_MARKER = r"(?iU)\b(subsp(\.|ecies)?|ssp\.?)\b"

# Serotypes, epithets and codes.
SEROTYPE_PAIR = r"(?iU)\b(O\d+[A-Za-z]?)\s*[:\-_ ]\s*((?:H|K)\d+[A-Za-z]?)\b"
SEROTYPE_LONE = r"(?iU)\b(O\d+[A-Za-z]?)\b"
SEROTYPE_GLUED = r"(?iU)\b(O\d+[A-Za-z]?)[:\-_ ]((?:H|K)\d+[A-Za-z]?)\b"
DIGIT_GRID = r"(?iU)\b(?:\d+(?:\s+\d+)+)\s+([A-Za-z]*[A-Za-z]\d[A-Za-z0-9-]*)\b"
EPITHET = r"^[a-z][a-z-]*$"
ADMIN_WORD = r"(?i)^(sp|spp|strain|str|substr|subspecies|cf|aff|pv|var|biovar|serovar)$"
CODE_WORD = r"^[A-Za-z][A-Za-z0-9]{0,6}$"
CODE_WORD_SEPARATED = r"^[A-Za-z][A-Za-z0-9]{0,6}[-_./]$"
CODE_NUMBER = r"(?U)^\d+[A-Za-z0-9-]*$"
STRAIN_TOKEN = r"^[A-Za-z]{1,5}[A-Za-z0-9_.-]+[A-Za-z0-9_]$"
YEAR = r"(?U)^(19|20)\d{2}$"
LOOSE_PUNCT = r"[\[\]\(\)\{\}:;,\|]+"


def _alternatives(prefixes):
    return "|".join(prefixes)


def code_in_text(prefixes):
    """Collection code as written in running text."""
    return rf"(?iU)\b({_alternatives(prefixes)})\s*[-/]?[A-Z]*\s*\d+[A-Za-z0-9-]*\b"


def code_underscored(prefixes):
    return (
        rf"(?iU)(?<![A-Za-z0-9])({_alternatives(prefixes)})(?:_[A-Z]+)?_\d+[A-Za-z0-9-]*"
        r"(?![A-Za-z0-9])"
    )


def code_compact(prefixes):
    return (
        rf"(?iU)(?<![A-Za-z0-9])({_alternatives(prefixes)})[A-Z]*\d+[A-Za-z0-9-]*"
        r"(?![A-Za-z0-9])"
    )


def code_after_epithet(prefixes):
    return rf"(?iU)\b({_alternatives(prefixes)})\s*[-_/]?\s*[A-Z]*\s*\d+[A-Za-z0-9-]*\b"


def code_token(prefixes):
    """A whole token that is a collection code."""
    return rf"(?i)^({_alternatives(prefixes)})_[A-Za-z0-9-]+$"


def code_with_space(prefixes):
    return rf"(?iU)\b({_alternatives(prefixes)})\s+([A-Za-z0-9-]+)\b"


def code_or_word_number(prefixes):
    return (
        rf"(?iU)\b(?:{_alternatives(prefixes)})\s*[-_/]?[A-Z]*\s*\d+[A-Za-z0-9-]*\b|"
        r"\b[A-Za-z][A-Za-z0-9]{1,6}[-_./]?\s*\d+[A-Za-z0-9-]*\b"
    )


# Match bands, final bands and report states, in report order.
BANDS = ["auto-accept", "grey-zone", "flag", "not-accept"]
FINAL_BANDS = ["green", "yellow_green", "yellow", "red", "black"]
STATES = [
    ("GREEN", "unambiguous"),
    ("YELLOW_GREEN", "high_similarity"),
    ("YELLOW", "near_tier"),
    ("RED", "low_similarity"),
    ("BLACK", "no_correspondence"),
]

# Column priorities of the query table.
NAME_COLUMNS = ["taxa_name", "taxon", "name", "organism", "species"]
ABUNDANCE_COLUMNS = [
    "abundance", "relative_abundance", "rel_abundance", "count", "value", "proportion",
]

# Taxonomy dump: default clade roots and the name classes that are kept.
DEFAULT_CLADES = ["2", "2157"]
ALTERNATE_CLASSES = {
    "synonym": "Synonym",
    "genbank synonym": "GenbankSynonym",
    "equivalent name": "EquivalentName",
    "includes": "Includes",
}

# Reasons written by the scoring ladder.
REASONS = {
    0: "no genus/species parsed from model",
    100: "exact genus+species match",
    75: "genus + 'sp' placeholder match",
    70: "genus matches and NCBI canonical is 'Genus sp'",
    60: "genus matches NCBI lineage",
    20: "weak/partial token overlap",
}
NO_RECORD = "No NCBI record"
NO_CANDIDATE = "No scored candidate"
WHY_MISSING = "unchanged: missing fields for strict check"
WHY_ELEVATED = (
    "species elevation: subspecies epithet equals promoted species in model (promoted to full_exact)"
)
WHY_FULL = "full 1:1 normalized match after GS synonymization"
WHY_TIES = "GS exact via canonical/alias, but downgraded to RED: high 100s-tie count"
WHY_SOFT = (
    "soft-rescue (Stage B): tie structure consistent with species-level agreement, "
    "but no GS equality"
)
WHY_GS = "GS exact via canonical or pool alias (synonym/reclassification)"
NOTE_YELLOW_GREEN = " | reclassified to YELLOW_GREEN: unique 100-score top candidate"
NOTE_RED = (
    "downgraded to RED: excessive candidate degeneracy (n_top_ties > 10 or n_100s > 10)"
)
