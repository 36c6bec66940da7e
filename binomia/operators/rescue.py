"""Judge weak matches with the taxonomy: score, rank and recolour candidates."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.expr import let, strip, words
from ..functions.names import (
    canonical_form, genus_species, genus_species_pairs, has_subspecies_marker,
    infraspecific_epithet, model_genus_species, plain_name, strict_id, strict_parts,
)
from ..session import cut_lineage
from .lookup import Lookup, expanded_aliases, expanded_pool, find_records, record_pools

NAMES = "array<string>"


def candidate_list(text) -> Column:
    """Candidates of a ``;`` list or a bracketed list of quoted names."""
    s = strip(text)
    bracketed = s.startswith("[") & s.endswith("]")
    parsed = F.from_json(F.translate(s, "'", '"'), F.lit(NAMES))
    listed = F.when(bracketed, F.coalesce(parsed, F.split(s, ";"))).otherwise(F.split(s, ";"))
    trimmed = F.filter(F.transform(listed, strip), lambda c: c != "")
    return F.coalesce(trimmed, F.array().cast(NAMES))


def candidates_or_match(text, mat) -> Column:
    """Candidates, or the match itself when there are none."""
    single = F.when(strip(mat) != "", F.array(strip(mat)))
    return let(
        candidate_list(text),
        lambda c: F.when(F.size(c) > 0, c).otherwise(F.coalesce(single, F.array().cast(NAMES))),
    )


def model_pair(model) -> Column:
    """Genus and epithet of a model in canonical form, null where the identifier has none."""
    return let(
        words(model_genus_species(model)),
        lambda gs: F.when(
            F.size(gs) >= 2,
            F.struct(canonical_form(gs[0]).alias("g"), canonical_form(gs[1]).alias("s")),
        ),
    )


def pair_score(g, s) -> Column:
    """How well a model's genus and epithet agree with the names of a record, 20 to 100.

    Reads the record's columns of :func:`.lookup.with_canonical_pool`.
    """
    moved = F.array_contains("genera_one", g) & F.array_contains("epithets_one", s)
    exact = moved | F.array_contains("names_canon", F.concat(g, F.lit(" "), s))
    return (
        F.when(exact & (s != "sp"), 100)
        .when((s == "sp") & F.array_contains("sp_heads", g), 75)
        .when(F.array_contains("genera_canon", g), F.when(F.col("canonical_is_sp"), 70).otherwise(60))
        .otherwise(20)
    )


def reason_of(score) -> Column:
    out = F.lit(None).cast("string")
    for value, text in V.REASONS.items():
        out = F.when(score == value, text).otherwise(out)
    return out


#: Scores a candidate can have: no genus and species, nothing shared, then as in pair_score.
LEVELS = (0, 20, 60, 70, 75, 100)


def median_of_counts(counts) -> Column:
    """Median score of so many candidates at each level, null for none."""
    total = sum(counts.values(), F.lit(0))

    def at(place):
        below, out = F.lit(0), None
        for level in LEVELS:
            below = below + counts[level]
            hit = place < below
            out = F.when(hit, level) if out is None else out.when(hit, level)
        return out

    low, high = F.floor((total - 1) / 2), F.floor(total / 2)
    return F.when(total > 0, (at(low) + at(high)) / F.lit(2.0))


def summary_of_counts(counts) -> Column:
    """Tier, top score, ties at the top and medians from the number of candidates at each level."""

    def build(c):
        n = {level: c[f"n{level}"] for level in LEVELS}
        top = n_top = None
        for level in reversed(LEVELS):
            top = F.when(n[level] > 0, level) if top is None else top.when(n[level] > 0, level)
            n_top = F.when(n[level] > 0, n[level]) if n_top is None else n_top.when(n[level] > 0, n[level])
        known = F.struct(F.coalesce(top, F.lit(0)).alias("top"), F.coalesce(n_top, F.lit(0)).alias("n"))
        return let(known, lambda k: summary(n, k["top"], k["n"]))

    def summary(n, top, n_top):
        rest = {level: F.when(F.lit(level) < top, n[level]).otherwise(F.lit(0)) for level in LEVELS}
        return let(median_of_counts(rest), lambda other: verdict(n, top, n_top, other))

    def verdict(n, top, n_top, other):
        steady = other.isNull() | (other < 75)
        tier = (
            F.when(top < 100, "red")
            .when(n_top == 1, "green")
            .when(n_top > 5, "red")
            .when(steady, "yellow")
            .otherwise("red")
        )
        return F.struct(
            tier.alias("tier"),
            n_top.cast("int").alias("n_top"),
            top.alias("top_score"),
            other.alias("median_other"),
            median_of_counts(n).alias("median_score"),
            n[100].cast("int").alias("n_100s"),
        )

    return let(F.struct(*[F.coalesce(counts[v], F.lit(0)).alias(f"n{v}") for v in LEVELS]), build)


def score_summary(scores) -> Column:
    """:func:`summary_of_counts` of an array of scores."""

    def count(s, level):
        return F.size(F.filter(s, lambda x: x == level))

    some = F.coalesce(scores, F.array().cast("array<int>"))
    return let(some, lambda s: summary_of_counts({v: count(s, v) for v in LEVELS}))


@dataclass
class Scores:
    """Scores of tie sets against records, without a list in any cell.

    ``members`` has each distinct model of a tie set once (tie_id, model, place, g, s). ``hits``
    has one row for each record, tie set, genus and epithet whose score may exceed 20 (n models,
    the best of them); all other members have 20, or 0 without genus and species. ``pairs`` sums up
    each (rec_id, tie_id).
    """

    members: DataFrame
    hits: DataFrame
    pairs: DataFrame


def score_ties(pairs: DataFrame, ties: DataFrame, pools: DataFrame) -> Scores:
    """Score the members of ``ties`` (tie_id, place, model) for distinct ``pairs`` (rec_id, tie_id).

    Models of one genus and epithet are counted once for each tie set, and only those whose genus is
    one of the record's meet the record; what remains of a tie set is known from its totals.
    """
    distinct = ties.groupBy("tie_id", "model").agg(F.min("place").alias("place"))
    members = cut_lineage(
        distinct.withColumn("pair", model_pair(F.col("model"))).select(
            "tie_id", "model", "place", F.col("pair.g").alias("g"), F.col("pair.s").alias("s")
        )
    )
    order = F.struct(F.char_length("model").alias("length"), "place", "model")
    groups = cut_lineage(
        members.groupBy("tie_id", "g", "s").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("best"))
    )
    has = F.col("g").isNotNull()
    totals = groups.groupBy("tie_id").agg(
        F.sum("n").alias("n_all"),
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("n_named"),
        F.min(F.when(has, F.col("best"))).alias("best_named"),
        F.min(F.when(~has, F.col("best"))).alias("best_other"),
    )
    met = pairs.join(pools.select("rec_id", "heads", *SCORING), "rec_id").select(
        "rec_id", "tie_id", *SCORING, F.explode("heads").alias("g")
    )
    hits = (
        met.join(groups, ["tie_id", "g"])
        .select("rec_id", "tie_id", "g", "s", "n", "best", pair_score(F.col("g"), F.col("s")).alias("score"))
        .where("score > 20")
    )
    at = {v: F.coalesce(F.sum(F.when(F.col("score") == v, F.col("n"))), F.lit(0)).alias(f"n{v}") for v in LEVELS[2:]}
    first = F.struct((-F.col("score")).alias("neg"), "best")
    counted = hits.groupBy("rec_id", "tie_id").agg(*at.values(), F.min(first).alias("first"))
    known = {v: F.coalesce(f"n{v}", F.lit(0)) for v in LEVELS[2:]}
    n_hits = sum(known.values(), F.lit(0))
    best = F.coalesce("first.best.model", "best_named.model", "best_other.model")
    top = F.coalesce(-F.col("first.neg"), F.when(F.col("n_named") > 0, 20), F.lit(0))
    counts = {0: F.col("n_all") - F.col("n_named"), 20: F.col("n_named") - n_hits, **known}
    summed = pairs.join(totals, "tie_id").join(counted, ["rec_id", "tie_id"], "left").select(
        "rec_id", "tie_id", F.col("n_all").cast("int").alias("n_ranked"),
        best.alias("best_model"), reason_of(top).alias("best_reason"), summary_of_counts(counts).alias("_sum"),
    )
    return Scores(members, hits, summed)


def ranked_texts(pairs: DataFrame, scores: Scores) -> DataFrame:
    """``ranked_candidates`` of each pair as text, for files: ``model@@score@@reason`` joined by ``;``.

    Best first, then shorter, then as given.
    """
    rest = F.when(F.col("g").isNull(), 0).otherwise(20)
    rows = pairs.join(scores.members, "tie_id").join(
        scores.hits.select("rec_id", "tie_id", "g", "s", "score"), ["rec_id", "tie_id", "g", "s"], "left"
    ).withColumn("score", F.coalesce("score", rest))
    item = F.concat_ws("@@", "model", F.col("score").cast("string"), reason_of(F.col("score")))
    ranked = F.struct((-F.col("score")).alias("neg"), F.char_length("model").alias("length"), "place", item.alias("item"))
    return rows.groupBy("rec_id", "tie_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(ranked)), lambda r: r["item"]), ";").alias("ranked_candidates")
    )


def match_level(name, model, canonical_gs, aliases, genera=None, epithets=None) -> Column:
    """``full_exact``, ``gs_exact`` or ``none`` for a name and a model identifier.

    Each of ``epithets`` under each of ``genera`` counts as an alias, too.
    """
    none = F.array().cast(NAMES)
    genera = F.coalesce(genera, none) if genera is not None else none
    epithets = F.coalesce(epithets, none) if epithets is not None else none

    def compare(x):
        own = F.struct(F.get(x["c"], F.lit(0)).alias("g"), F.get(x["c"], F.lit(1)).alias("s"))
        others = F.filter(aliases, lambda a: (a["g"] != "") & (a["s"] != ""))
        return let(F.concat(F.array(own), others), lambda pairs: level(x, pairs))

    def level(x, pairs):
        tail = F.slice(x["n"], F.lit(3), F.greatest(F.size(x["n"]) - 2, F.lit(0)))
        full = F.exists(
            pairs,
            lambda p: F.array_join(F.concat(F.array(p["g"], p["s"]), tail), "_") == x["id"],
        )
        pair = F.exists(
            pairs,
            lambda p: F.get(x["m"], F.lit(0)).eqNullSafe(p["g"])
            & F.get(x["m"], F.lit(1)).eqNullSafe(p["s"]),
        )
        # genus, epithet and tail make up the identifier: what lies between is looked for
        end = F.when(F.size(tail) > 0, F.concat(F.lit("_"), F.array_join(tail, "_"))).otherwise("")

        def moved(g):
            room = F.char_length(x["id"]) - F.char_length(g) - F.char_length(end) - 1
            inner = F.substring(x["id"], F.char_length(g) + 2, F.greatest(room, F.lit(0)))
            return (
                (g != "") & (room > 0) & F.array_contains(epithets, inner)
                & (F.concat(g, F.lit("_"), inner, end) == x["id"])
            )

        m0, m1 = F.get(x["m"], F.lit(0)), F.get(x["m"], F.lit(1))
        moved_pair = F.array_contains(genera, m0) & F.array_contains(epithets, m1) & (m0 != "") & (m1 != "")
        return (
            F.when((F.size(x["n"]) < 2) | (F.size(x["c"]) < 2), "none")
            .when(full | F.exists(genera, moved), "full_exact")
            .when(pair | F.coalesce(moved_pair, F.lit(False)), "gs_exact")
            .otherwise("none")
        )

    return let(
        F.struct(
            strict_parts(name).alias("n"),
            strict_parts(canonical_gs).alias("c"),
            strict_parts(model).alias("m"),
            strict_id(model).alias("id"),
        ),
        compare,
    )


def elevated(name, model) -> Column:
    """A subspecies in the name is the species of the model."""
    epithet = F.lower(infraspecific_epithet(name))
    n, m = strict_parts(name), strict_parts(model)
    return F.coalesce(
        has_subspecies_marker(name)
        & (F.size(n) >= 2)
        & (F.size(m) >= 2)
        & (epithet != F.get(n, F.lit(1)))
        & (F.get(m, F.lit(0)) == F.get(n, F.lit(0)))
        & (F.get(m, F.lit(1)) == epithet),
        F.lit(False),
    )


def soft_yellow(n_top_ties, top_score, median_score) -> Column:
    """A top score with few ties and no strong rest."""
    return (top_score >= 100) & (n_top_ties <= 5) & (median_score.isNull() | (median_score < 70))


def first_verdict(name, model, level, is_elevated, confidence, n_top_ties, top_score) -> Column:
    """Colour, level and rationale before the frame-wide corrections.

    The medians are not known yet at this point, so :func:`soft_yellow` sees null.
    """

    def verdict(color, level_, why):
        return F.struct(
            (F.lit(color) if isinstance(color, str) else color).alias("color"),
            F.lit(level_).alias("level"),
            F.lit(why).alias("why"),
        )

    missing = (F.coalesce(strip(name), F.lit("")) == "") | (
        F.coalesce(strip(model), F.lit("")) == ""
    )
    soft = soft_yellow(n_top_ties, top_score, F.lit(None).cast("double"))
    return (
        F.when(missing, verdict(confidence, "none", V.WHY_MISSING))
        .when(is_elevated, verdict("green", "full_exact", V.WHY_ELEVATED))
        .when(level == "full_exact", verdict("green", "full_exact", V.WHY_FULL))
        .when((level == "gs_exact") & (n_top_ties > 10), verdict("red", "gs_exact", V.WHY_TIES))
        .when(soft, verdict("yellow", "none", V.WHY_SOFT))
        .otherwise(verdict("yellow", "gs_exact", V.WHY_GS))
    )


def final_verdict(verdict, n_top_ties, top_score, n_100s, median_score) -> Column:
    """Apply the corrections in order: unique top, heavy ties, not found."""
    unique = (verdict["color"] == "yellow") & (top_score >= 99.999) & (n_top_ties == 1)
    color = F.when(unique, "yellow_green").otherwise(verdict["color"])
    heavy = (color == "yellow") & ((n_top_ties > 10) | (n_100s > 10))
    lost = (median_score.isNull() | (median_score <= 20)) & (top_score.isNull() | (top_score <= 20))
    why = (
        F.when(unique, F.concat(verdict["why"], F.lit(V.NOTE_YELLOW_GREEN)))
        .when(heavy, F.concat(verdict["why"], F.lit(V.NOTE_RED)))
        .otherwise(verdict["why"])
    )
    return F.struct(
        F.when(lost, "black").when(heavy, "red").otherwise(color).alias("final_color"),
        F.when(lost, "none").otherwise(verdict["level"]).alias("match_level"),
        why.alias("rationale_final"),
        lost.alias("is_not_found"),
    )


def model_core(model) -> Column:
    return F.regexp_replace(F.coalesce(strip(model), F.lit("")), r"(?i)\.mat$", "")


def reclassify(scored: DataFrame) -> DataFrame:
    """Add the final colour and its grounds to scored rows."""
    core = model_core(F.col("suggested_gem"))
    gs = F.coalesce(F.col("canonical_gs"), F.lit(""))
    moved = [F.col(c) if c in scored.columns else None for c in ("alias_genera", "alias_epithets")]
    first = first_verdict(
        F.col("taxon"),
        core,
        match_level(F.col("taxon"), core, gs, F.col("gs_aliases"), *moved),
        elevated(F.col("taxon"), core),
        F.col("confidence"),
        F.col("n_top_ties"),
        F.col("top_score"),
    )
    final = final_verdict(
        F.col("_first"), F.col("n_top_ties"), F.col("top_score"), F.col("n_100s"), F.col("median_score")
    )
    out = scored.withColumn("_first", first).withColumn("_final", final).select("*", "_final.*")
    lost = F.col("is_not_found")
    changes = {
        "suggested_gem": F.when(lost, "no_suggestion").otherwise(F.col("suggested_gem")),
        "final_band": F.col("final_color"),
    }
    if "ranked_candidates" in scored.columns:
        changes["ranked_candidates"] = F.when(lost, "no candidates").otherwise(F.col("ranked_candidates"))
    return out.drop("_first", "_final").withColumns(changes)


def ranked_list(candidates) -> Column:
    """Distinct candidates of a row with score and reason: best first, then shorter, then as given."""

    def entry(m, i):
        return let(
            model_pair(m),
            lambda p: F.struct(
                (-F.when(p.isNull(), 0).otherwise(pair_score(p["g"], p["s"]))).alias("neg"),
                F.char_length(m).alias("length"),
                i.alias("place"),
                m.alias("model"),
            ),
        )

    return F.transform(
        F.sort_array(F.transform(F.array_distinct(candidates), entry)),
        lambda s: F.struct(s["model"].alias("model"), (-s["neg"]).alias("score"), reason_of(-s["neg"]).alias("reason")),
    )


def ranked_text(ranked) -> Column:
    """``model@@score@@reason`` items joined by ``;``."""
    items = F.transform(
        ranked, lambda c: F.concat_ws("@@", c["model"], c["score"].cast("string"), c["reason"])
    )
    return F.coalesce(F.array_join(items, ";"), F.lit(""))


TEXT_COLUMNS = ["ranked_candidates", "synonyms", "gs_aliases"]


def _with_record(rows: DataFrame, other: DataFrame, *more: str) -> DataFrame:
    """Left join on ``rec_id`` and more columns; rows without a record are spread, not gathered under null."""
    key = F.coalesce("rec_id", F.concat(F.lit("\u0001"), "taxon"))
    keyed = rows.withColumn("_rec", key)
    return keyed.join(other.withColumnRenamed("rec_id", "_rec"), ["_rec", *more], "left").drop("_rec")


RECORD_SCALARS = ["canonical", "rank", "taxid", "lineage_genera"]
POOL_FACTORS = ["pool_names", "pool_genera", "pool_epithets"]
SCORING = ["genera_one", "epithets_one", "names_canon", "sp_heads", "genera_canon", "canonical_is_sp"]


@dataclass
class Rescued:
    """Rescued rows, and what the texts that only files show are made from.

    Rows that came with their candidates as text have them ranked in ``ranked``; other rows name
    their tie set, and ``scores`` has the scores.
    """

    rows: DataFrame
    pools: DataFrame
    pairs: DataFrame | None = None
    scores: Scores | None = None

    def with_texts(self) -> DataFrame:
        """The rows with the columns that only files show."""
        rows = self.rows.drop("gs_aliases", "alias_genera", "alias_epithets")
        if self.scores is None:
            rows = rows.withColumn("ranked_candidates", ranked_text(F.col("ranked"))).drop("ranked")
        else:
            rows = _with_record(rows, ranked_texts(self.pairs, self.scores), "tie_id").drop("tie_id")
        ranked = F.coalesce("ranked_candidates", F.lit(""))
        if "is_not_found" in rows.columns:
            ranked = F.when(F.col("is_not_found"), "no candidates").otherwise(ranked)
        if "pool_names" not in rows.columns:
            rows = _with_record(rows, self.pools.select("rec_id", *POOL_FACTORS))
        return rows.withColumns(
            {
                "ranked_candidates": ranked,
                "synonyms": F.coalesce(F.array_join(expanded_pool(), "|"), F.lit("")),
                "gs_aliases": F.coalesce(expanded_aliases(), genus_species_pairs(F.array().cast(NAMES))),
            }
        ).drop("rec_id", *POOL_FACTORS)


def score_rows(rows: DataFrame, pools: DataFrame, keys: DataFrame, ties: DataFrame | None = None) -> Rescued:
    """Look up every row, score its candidates and summarise the scores.

    Candidates are the members of the row's ``tie_id`` in ``ties`` (tie_id, place, model), scored as
    relations. Without ``ties`` each row has its own list in ``mat_candidates_str`` and is scored where
    it is. The rows get ``rec_id``; their aliases stay factors.
    """
    base = rows.withColumn("taxon", plain_name(F.col("taxon")))
    if ties is not None:
        base = base.withColumn("n_listed", F.col("n_candidates"))
    found = find_records(base, keys)
    own = base.drop(*[c for c in [*RESCUE_COLUMNS, "rec_id"] if c in base.columns])
    known = F.col("rec_id").isNotNull()
    pairs = scores = None
    if ties is None:
        mat = F.col("mat") if "mat" in rows.columns else F.lit(None).cast("string")
        own = own.withColumn("_cands", candidates_or_match(F.col("mat_candidates_str"), mat))
        record = found.join(pools.select("rec_id", *RECORD_SCALARS, *POOL_FACTORS, *SCORING), "rec_id")
        joined = own.join(record, "taxon", "left").withColumn("n_listed", F.size("_cands"))
        best = F.get("ranked", F.lit(0))
        joined = joined.withColumn("ranked", F.when(known, ranked_list(F.col("_cands")))).withColumns(
            {
                "_sum": score_summary(F.transform("ranked", lambda c: c["score"])),
                "n_ranked": F.size("ranked"),
                "best_model": best["model"],
                "best_reason": best["reason"],
            }
        )
        more = ["ranked", *POOL_FACTORS]
    else:
        pools = cut_lineage(pools)
        located = cut_lineage(own.join(found, "taxon", "left"))
        pairs = located.where("rec_id is not null").select("rec_id", "tie_id").distinct()
        scores = score_ties(pairs, ties, pools)
        record = pools.select("rec_id", *RECORD_SCALARS, *POOL_FACTORS)
        joined = _with_record(_with_record(located, scores.pairs, "tie_id"), record)
        missing = summary_of_counts({v: F.lit(0) for v in LEVELS})
        joined = joined.withColumn("_sum", F.coalesce("_sum", missing))
        more = ["tie_id"]
    rationale = F.when(~known, V.NO_RECORD).otherwise(F.coalesce("best_reason", F.lit(V.NO_CANDIDATE)))
    nothing = F.array().cast(NAMES)
    lower = lambda names: F.transform(F.coalesce(names, nothing), F.lower)
    out = joined.withColumns(
        {
            "canonical": F.coalesce("canonical", F.lit("")),
            "rank": F.coalesce("rank", F.lit("")),
            "suggested_gem": F.coalesce("best_model", F.lit("")),
            "lineage_genera": F.coalesce(F.array_join("lineage_genera", "|"), F.lit("")),
            "n_candidates": F.when(known, F.coalesce("n_ranked", F.lit(0))).otherwise(F.col("n_listed")),
            "ncbi_taxid": F.coalesce("taxid", F.lit("")),
            "confidence": F.col("_sum.tier"),
            "tier": F.col("_sum.tier"),
            "n_top_ties": F.col("_sum.n_top"),
            "top_score": F.col("_sum.top_score"),
            "rationale_scoring": rationale,
            "n_100s": F.col("_sum.n_100s"),
            "median_score": F.col("_sum.median_score"),
            "gs_aliases": genus_species_pairs(F.coalesce("pool_names", nothing)),
            "alias_genera": lower("pool_genera"),
            "alias_epithets": F.transform(lower("pool_epithets"), lambda e: F.rtrim(e, F.lit("."))),
        }
    ).withColumn("canonical_gs", genus_species(F.col("canonical")))
    kept = [c for c in rows.columns if c not in RESCUE_COLUMNS and c not in ("rec_id", "tie_id", "ranked", *POOL_FACTORS)]
    columns = [c for c in RESCUE_COLUMNS if c not in TEXT_COLUMNS]
    factors = ["gs_aliases", "alias_genera", "alias_epithets"]
    return Rescued(out.select(*kept, "rec_id", *more, *columns, *factors), pools, pairs, scores)


def score_names(rows: DataFrame, pools: DataFrame, keys: DataFrame) -> DataFrame:
    """Scored rows with all texts, from rows with ``mat_candidates_str``."""
    kept = [c for c in rows.columns if c not in RESCUE_COLUMNS]
    return score_rows(rows, pools, keys).with_texts().select(*kept, *RESCUE_COLUMNS)


RESCUE_COLUMNS = [
    "suggested_gem", "canonical", "rank", "lineage_genera", "synonyms", "n_candidates",
    "ranked_candidates", "ncbi_taxid", "confidence", "tier", "n_top_ties", "top_score",
    "rationale_scoring", "canonical_gs", "gs_aliases", "n_100s", "median_score",
]


def rescue_ties(rows: DataFrame, lookup: Lookup, ties: DataFrame | None = None) -> Rescued:
    """Rescue rows with ``taxon`` and candidates as :func:`score_rows` reads them; other columns are kept."""
    found = score_rows(rows, record_pools(lookup), lookup.keys, ties)
    final = reclassify(found.rows).drop("gs_aliases", "alias_genera", "alias_epithets")
    return Rescued(final, found.pools, found.pairs, found.scores)


def rescue(rows: DataFrame, lookup: Lookup) -> DataFrame:
    """Rescued rows with all texts, from rows with ``mat_candidates_str``."""
    return rescue_ties(rows, lookup).with_texts()
