"""Find the taxonomy record of a name and the names it answers to.

A lookup is two tables: ``keys(key, ord, rec_id, scientific_name)`` and
``records(rec_id, record)``. Names are looked up by their distinct values; what a
record answers to is worked out once per record, not once per name.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.expr import words
from ..functions.names import (
    binomial, canonical_form, canonical_is_placeholder, genus_species_pairs, lookup_variants,
)
from ..session import cut_lineage
from .taxonomy import ids_key

NAMES = "array<string>"


@dataclass
class Lookup:
    keys: DataFrame
    records: DataFrame


def from_taxonomy(records: DataFrame, keys: DataFrame) -> Lookup:
    """Lookup over compiled records; every key leads to one record."""
    # looked up for names and for former ids
    return Lookup(
        cut_lineage(
            keys.select("key", F.lit(0).alias("ord"), F.col("taxid").alias("rec_id"), "scientific_name")
        ),
        records.select(F.col("taxid").alias("rec_id"), "record"),
    )


def find_records(names: DataFrame, keys: DataFrame) -> DataFrame:
    """``taxon, rec_id`` for the distinct names that have a record.

    The first spelling with a record wins; of several records under it the one with
    exactly this scientific name, else the first.
    """
    spelled = names.select("taxon").distinct().select(
        "taxon", F.posexplode(lookup_variants(F.col("taxon"))).alias("v_pos", "variant")
    )
    found = spelled.withColumn("key", F.concat(F.lit("TAX::"), "variant")).join(keys, "key")
    order = F.struct(
        "v_pos", (~F.col("taxon").eqNullSafe(F.col("scientific_name"))).alias("other"), "ord"
    )
    return found.groupBy("taxon").agg(F.min_by("rec_id", order).alias("rec_id"))


def record_names(record) -> Column:
    """All names of a record as sorted distinct binomials."""
    other = record["OtherNames"]
    lists = [F.coalesce(other[c], F.array().cast(NAMES)) for c in V.ALTERNATE_CLASSES.values()]
    shown = F.transform(other["Name"], lambda n: n["DispName"])
    names = F.concat(
        F.array(record["ScientificName"]), *lists, F.coalesce(shown, F.array().cast(NAMES))
    )
    return tidy(F.transform(names, binomial))


def tidy(names) -> Column:
    return F.sort_array(F.array_distinct(F.filter(names, lambda n: n != "")))


def lineage_genera(record) -> Column:
    genus = F.filter(record["LineageEx"], lambda s: s["Rank"] == "genus")
    found = F.transform(genus, lambda s: s["ScientificName"])
    return F.coalesce(tidy(found), F.array().cast(NAMES))


def parse_records(records: DataFrame) -> DataFrame:
    """Canonical name, rank, genera and synonyms of every record."""
    r = F.col("record")
    parsed = records.select(
        "rec_id",
        binomial(r["ScientificName"]).alias("canonical"),
        F.coalesce(r["TaxId"], F.lit("")).alias("taxid"),
        F.coalesce(r["Rank"], F.lit("")).alias("rank"),
        lineage_genera(r).alias("lineage_genera"),
        record_names(r).alias("synonyms"),
        ids_key(
            F.concat(
                F.coalesce(r["AkaTaxIds"], F.array().cast(NAMES)),
                F.coalesce(r["MergedTaxIds"], F.array().cast(NAMES)),
            )
        ).alias("ids_key"),
    )
    w = words(F.col("canonical"))
    return parsed.withColumns(
        {
            "genus": F.coalesce(F.get(w, F.lit(0)), F.lit("")),
            "species_epithet": F.coalesce(F.get(w, F.lit(1)), F.lit("")),
        }
    )


def with_merged_synonyms(parsed: DataFrame, keys: DataFrame) -> DataFrame:
    """Add the synonyms of the records stored under a record's former ids."""
    own = parsed.where(F.col("ids_key").isNotNull()).select("rec_id", "ids_key")
    targets = keys.select(F.col("key").alias("ids_key"), F.col("rec_id").alias("other"))
    extra = (
        own.join(targets, "ids_key")
        .where(F.col("other") != F.col("rec_id"))
        .join(parsed.select(F.col("rec_id").alias("other"), F.col("synonyms").alias("more")), "other")
        .groupBy("rec_id")
        .agg(F.array_distinct(F.flatten(F.collect_list("more"))).alias("more"))
    )
    return (
        parsed.join(extra, "rec_id", "left")
        .withColumn("synonyms", tidy(F.concat("synonyms", F.coalesce("more", F.array().cast(NAMES)))))
        .drop("more")
    )


def with_pool(parsed: DataFrame) -> DataFrame:
    """Add the names of a record without writing out their products.

    A record answers to its names and to every epithet of a name under every genus of its
    lineage. ``pool_names`` holds the former, ``pool_genera`` and ``pool_epithets`` stand for
    the latter. A genus of several words leads to one name whatever the epithet, and one that
    opens a bracket may join with the epithet; both are written out as names.
    """
    name = F.lit(" ")
    nothing = F.array().cast(NAMES)
    names = parsed.withColumn("_names", F.concat(F.array("canonical"), "synonyms"))
    split = F.filter(F.transform("_names", words), lambda w: F.size(w) >= 2)
    bracket = F.filter("lineage_genera", lambda g: F.startswith(g, F.lit("[")))
    opened = F.transform(
        F.filter("lineage_genera", lambda g: ~F.startswith(g, F.lit("["))), words
    )
    plain = F.transform(F.filter(opened, lambda w: F.size(w) == 1), lambda w: w[0])
    longer = F.transform(
        F.filter(opened, lambda w: F.size(w) >= 2), lambda w: F.concat(w[0], name, w[1])
    )
    written = F.flatten(
        F.transform(bracket, lambda g: F.transform("pool_epithets", lambda e: F.concat(g, name, e)))
    )
    fixed = F.when(F.size("pool_epithets") > 0, F.concat(longer, written)).otherwise(nothing)
    return (
        names.withColumn("pool_epithets", F.array_distinct(F.transform(split, lambda w: w[1])))
        .withColumn("pool_genera", F.array_distinct(plain))
        .withColumn("pool_names", tidy(F.transform(F.concat("_names", fixed), binomial)))
        .drop("_names")
    )


def expanded_pool() -> Column:
    """All names of a record, written out for a file."""
    moved = F.transform(
        "pool_genera", lambda g: F.transform("pool_epithets", lambda e: F.concat(g, F.lit(" "), e))
    )
    return tidy(F.concat("pool_names", F.flatten(moved)))


def expanded_aliases() -> Column:
    """Lower-case (genus, epithet) pairs of all names, written out for a file."""
    return genus_species_pairs(expanded_pool())


def with_canonical_pool(pooled: DataFrame) -> DataFrame:
    """The same in the form that candidates are compared in.

    A genus and an epithet of one word each match the product; ``names_canon`` holds all other
    names of two words, ``sp_heads`` the genera that have a placeholder such as ``genus sp``.
    """
    single = lambda c: (c != "") & ~c.contains(" ")
    nothing = F.array().cast(NAMES)
    canon = pooled.withColumns(
        {
            "_g": F.transform("pool_genera", canonical_form),
            "_e": F.transform("pool_epithets", canonical_form),
            "_n": F.transform("pool_names", canonical_form),
        }
    )
    # where one side has no letters the other alone is the name
    lone = F.concat(
        "_n",
        F.when(F.array_contains("_e", ""), F.col("_g")).otherwise(nothing),
        F.when(F.array_contains("_g", ""), F.col("_e")).otherwise(nothing),
    )
    canon = canon.withColumns(
        {
            "names_canon": F.array_distinct(lone),
            "genera_one": F.array_distinct(F.filter("_g", single)),
            "epithets_one": F.array_distinct(F.filter("_e", single)),
        }
    )
    first = lambda c: F.get(words(c), F.lit(0))
    placeholders = F.filter(F.concat("names_canon", "_g"), canonical_is_placeholder)
    of_sp = F.exists("_e", lambda e: (e == "sp") | F.startswith(e, F.lit("sp ")))
    moved = F.filter("genera_one", lambda g: canonical_is_placeholder(F.concat(g, F.lit(" sp"))))
    heads = F.concat(F.transform(placeholders, first), F.when(of_sp, moved).otherwise(nothing))
    canon = canon.withColumn("sp_heads", F.array_distinct(heads)).withColumn(
        "genera_canon", F.transform("lineage_genera", canonical_form)
    )
    all_heads = F.concat(
        "genera_canon", "genera_one", "sp_heads", F.filter(F.transform("names_canon", first), lambda w: w.isNotNull())
    )
    return canon.withColumns(
        {
            "heads": F.array_distinct(all_heads),
            "canonical_is_sp": canonical_is_placeholder(canonical_form(F.col("canonical"))),
        }
    ).drop("_g", "_e", "_n")


def record_pools(lookup: Lookup) -> DataFrame:
    """One row per record with all that scoring needs."""
    parsed = cut_lineage(parse_records(lookup.records))
    return with_canonical_pool(with_pool(with_merged_synonyms(parsed, lookup.keys)))
