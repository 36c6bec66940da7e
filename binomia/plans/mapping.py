"""From a query table to the final mapping."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.anchors import (
    anchor_word_count, species_anchor, subspecies_anchor, with_compatibility_form,
)
from ..functions.names import clean_name, has_code
from ..operators.dedup import most_specific, with_group_position
from ..operators.lookup import Lookup
from ..operators.match import Matches, match_names, with_candidates
from ..operators.report import report_items
from ..operators.rescue import Rescued, rescue_ties
from ..operators.rows import merge_rescued, needs_rescue, with_last_abundance
from ..session import cut_lineage

MATCH_COLUMNS = [
    "taxa_name", "abundance", "taxon", "anchor", "mat", "j_score", "has_gs", "bands",
    "n_candidates", "mat_candidates_str", "subspp_anchor", "anchor_tokens",
    "anchor_tokens_base", "has_code_or_cc",
]


@dataclass
class Mapping:
    """A run as relations: rows name their tie set, whose members are in ``ties``."""

    inputs: DataFrame
    matched: DataFrame
    candidates: DataFrame
    rescued: DataFrame
    final: DataFrame
    items: DataFrame
    ties: DataFrame
    found: Rescued

    def texts(self) -> "Mapping":
        """The same with the lists that files show written out in the rows."""
        matched = cut_lineage(with_candidates(self.matched, self.ties).drop("tie_id"))
        rescued = cut_lineage(with_candidates(self.found.rows, self.ties).select("pos", "mat_candidates_str").join(
            self.found.with_texts(), "pos"
        ))
        final = cut_lineage(merge_rescued(matched, rescued))
        return Mapping(
            self.inputs, matched, needs_rescue(matched), rescued, final, report_items(final), self.ties, self.found
        )


def cleaned(queries: DataFrame) -> DataFrame:
    """Query rows with the cleaned name and the abundance of the last equal name."""
    return with_last_abundance(queries).withColumn("taxon", clean_name(F.col("taxa_name")))


def described(names: DataFrame, prefixes=V.COLLECTION_PREFIXES) -> DataFrame:
    """Anchor columns of distinct names."""
    named = names.select("taxon").distinct().withColumn("anchor", species_anchor(F.col("taxon")))
    formed = with_compatibility_form(named, "taxon", "_form")
    return (
        formed.withColumn(
            "subspp_anchor", subspecies_anchor(F.col("_form"), F.col("anchor"), prefixes)
        )
        .drop("_form")
        .withColumns(
            {
                "anchor_tokens": anchor_word_count(F.col("subspp_anchor"), prefixes),
                "anchor_tokens_base": anchor_word_count(F.col("anchor"), prefixes),
                "has_code_or_cc": has_code(F.col("taxon"), prefixes),
            }
        )
    )


def matched_ties(inputs: DataFrame, models: DataFrame, prefixes=V.COLLECTION_PREFIXES) -> tuple[DataFrame, Matches]:
    """Match cleaned rows and keep the most specific ones, with the ``tie_id`` of each.

    Names are matched and described once per distinct value.
    """
    matches = match_names(inputs, models, prefixes)
    best = matches.best.drop("anchor")
    # read by the group positions, the duplicates and the prefixes
    rows = cut_lineage(inputs.join(described(inputs, prefixes), "taxon").join(best, "taxon"))
    return with_group_position(most_specific(rows), rows), matches


def matched_rows(
    inputs: DataFrame, models: DataFrame, prefixes=V.COLLECTION_PREFIXES, text=True, form=None
) -> DataFrame:
    """:func:`matched_ties` with the tie sets as text, in the ``form`` that is wanted, or without them."""
    kept, matches = matched_ties(inputs, models, prefixes)
    # candidate texts are long: add them to the surviving rows only
    return (matches.with_candidates(kept, form) if text else kept).drop("tie_id")


def map_names(
    queries: DataFrame, models: DataFrame, lookup: Lookup, prefixes=V.COLLECTION_PREFIXES
) -> Mapping:
    """All steps of a mapping run. Matched, rescued and final rows are each worked out once and kept."""
    inputs = cleaned(queries)
    kept, matches = matched_ties(inputs, models, prefixes)
    matched, ties = cut_lineage(kept), cut_lineage(matches.all_ties())
    candidates = needs_rescue(matched)
    found = rescue_ties(candidates, lookup, ties)
    found.rows = rescued = cut_lineage(found.rows)
    final = cut_lineage(merge_rescued(matched, rescued.drop("rec_id")))
    return Mapping(inputs, matched, candidates, rescued, final, report_items(final), ties, found)
