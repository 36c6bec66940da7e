"""Cleaning, keys and lookup variants of names (Column -> Column)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .expr import among, blank_to_null, first_filled, let, squish, words


def clean_name(raw) -> Column:
    s = F.regexp_replace(raw, r"^\[([^\]]+)\]", "$1")
    s = F.regexp_replace(s, r"(?U)(\b[A-Za-z]{1,4})-([0-9]+)\b", "$1 $2")
    s = F.regexp_replace(s, "[,;]+", "")
    return F.coalesce(squish(s), F.lit(""))


def strip_authorship(s) -> Column:
    return F.regexp_replace(F.regexp_replace(s, V.AUTHOR_IN_PARENS, ""), V.AUTHOR_BARE, "")


def has_code(text, prefixes=V.COLLECTION_PREFIXES) -> Column:
    """1 where the text holds a collection code or a word-number pair, else 0."""
    return F.coalesce(text.rlike(V.code_or_word_number(prefixes)).cast("int"), F.lit(0))


def species_key(name) -> Column:
    """Name without authors, Candidatus, infraspecific tail and punctuation."""
    s = squish(name)
    s = F.regexp_replace(s, V.ANY_PARENS, " ")
    s = F.regexp_replace(s, V.BARE_EX_TAIL, "")
    s = F.regexp_replace(s, V.CANDIDATUS, "")
    s = F.regexp_replace(s, "(?isU)" + V.INFRASPECIFIC + ".*$", "")
    s = F.regexp_replace(s, V.LOOSE_PUNCT, " ")
    return F.coalesce(squish(s), F.lit(""))


def plain_name(raw) -> Column:
    """Drop a leading ``NAME::`` and collapse whitespace."""
    return F.coalesce(squish(F.regexp_replace(raw, r"^NAME::", "")), F.lit(""))


def binomial(s) -> Column:
    """First two words after opening a leading bracket; shorter names stay."""
    opened = F.regexp_replace(squish(s), r"(?U)^\[([^\]]+)\]\s*", "$1 ")
    return F.coalesce(
        let(
            opened,
            lambda o: let(
                words(o),
                lambda w: F.when(F.size(w) >= 2, F.concat(w[0], F.lit(" "), w[1])).otherwise(o),
            ),
        ),
        F.lit(""),
    )


def canonical_form(s) -> Column:
    """Lower case, with ``/ _ - .`` as blanks."""
    return F.coalesce(F.lower(squish(F.translate(s, "/_-.", "    "))), F.lit(""))


def is_placeholder(s) -> Column:
    return canonical_is_placeholder(canonical_form(s))


def canonical_is_placeholder(c) -> Column:
    return c.rlike(r"(?U)^\w+\s+sp(\s|$)")


def genus_species(canonical) -> Column:
    """First two words; shorter names stay as they are."""
    w = words(canonical)
    return F.coalesce(
        F.when(F.size(w) >= 2, F.concat_ws(" ", F.slice(w, 1, 2))).otherwise(canonical), F.lit("")
    )


def genus_species_pairs(pool) -> Column:
    """Lower-case (genus, epithet) pairs of an array of names."""
    split_names = F.filter(F.transform(pool, words), lambda w: F.size(w) >= 2)
    return F.array_distinct(
        F.transform(
            split_names,
            lambda w: F.struct(
                F.lower(w[0]).alias("g"), F.rtrim(F.lower(w[1]), F.lit(".")).alias("s")
            ),
        )
    )


def has_subspecies_marker(s) -> Column:
    return F.coalesce(s.rlike(V.SUBSPECIES_MARKER), F.lit(False))


def infraspecific_epithet(s) -> Column:
    return blank_to_null(F.regexp_extract(s, V.INFRASPECIFIC_PAIR, 2))


def without_parens(s) -> Column:
    return F.trim(F.regexp_replace(s, V.ANY_PARENS, " "))


def without_punct(s) -> Column:
    return squish(F.regexp_replace(s, V.LOOSE_PUNCT, " "))


def without_candidatus(s) -> Column:
    return squish(F.regexp_replace(s, V.CANDIDATUS, ""))


def without_infraspecific(s) -> Column:
    cut = squish(F.regexp_replace(s, "(?isU)" + V.INFRASPECIFIC + ".*$", ""))
    return squish(F.regexp_replace(cut, r"(?iU)\bsp\.?\s+\S.*$", "sp."))


def strain_token(s) -> Column:
    """Right-most word that looks like a strain name."""
    tokens = F.transform(words(s), lambda w: F.regexp_replace(w, r"[^A-Za-z0-9_.-]", ""))
    fits = F.filter(tokens, lambda t: ~among(F.lower(t), V.STRAIN_STOPS) & t.rlike(V.STRAIN_TOKEN))
    return F.get(F.reverse(fits), F.lit(0))


def lookup_variants(raw) -> Column:
    """Spellings of a name to look up, best first."""

    def build(name):
        return let(
            without_parens(name),
            lambda bare: let(
                without_punct(first_filled(bare, name)),
                lambda plain: let(
                    without_candidatus(first_filled(plain, bare, name)),
                    lambda cand: let(
                        without_infraspecific(first_filled(cand, plain, bare, name)),
                        lambda infra: tail(name, bare, plain, cand, infra),
                    ),
                ),
            ),
        )

    def tail(name, bare, plain, cand, infra):
        base = first_filled(infra, cand, plain, bare, name)
        return let(
            F.struct(strain_token(base).alias("token"), F.get(words(base), F.lit(0)).alias("genus")),
            lambda x: F.array_distinct(
                F.filter(
                    F.array(
                        name, bare, plain, cand, infra, species_key(name),
                        x["token"], F.concat(x["genus"], F.lit(" "), x["token"]), x["genus"],
                    ),
                    lambda v: v.isNotNull() & (v != ""),
                )
            ),
        )

    return let(squish(raw), build)


def model_genus_species(model) -> Column:
    """``Genus species`` read off a model identifier, or null."""
    return let(
        id_parts(model),
        lambda t: F.when(
            (F.size(t) >= 2) & t[0].rlike(r"(?U)^\p{Upper}"), F.concat(t[0], F.lit(" "), t[1])
        ),
    )


def id_parts(s) -> Column:
    """Parts of an identifier; blanks do not separate."""
    return F.filter(F.split(F.translate(s, "=:-./+()", "________"), "_"), lambda t: t != "")


def strict_id(s) -> Column:
    """Lower-case identifier with single underscores between word runs."""
    return F.lower(F.trim(F.regexp_replace(s, r"(?U)[\W_]+", "_"), F.lit("_")))


def strict_parts(s) -> Column:
    return F.filter(F.split(strict_id(s), "_"), lambda t: t != "")


def edge_stripped_words(s) -> Column:
    """Words without leading and trailing non-letters."""
    bare = F.transform(words(s), lambda w: F.regexp_replace(w, r"(?U)^[\W_]+|[\W_]+$", ""))
    return F.filter(F.coalesce(bare, F.array().cast("array<string>")), lambda t: t != "")


def display_name(x) -> Column:
    """Name without brackets, underscores as blanks."""
    return squish(F.translate(F.translate(x, "[]", ""), "_", " "))


def leading_letters(x) -> Column:
    return blank_to_null(F.regexp_extract(x, "^[A-Za-z]+", 0))


def truncated(x, width: int) -> Column:
    """At most ``width`` characters, the last three dots when something was cut."""
    return F.when(
        F.char_length(x) > width, F.concat(F.substring(x, 1, width - 3), F.lit("..."))
    ).otherwise(x)
