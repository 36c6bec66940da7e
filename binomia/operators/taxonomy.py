"""Compile a taxonomy dump into lookup keys and records.

Most nodes have no children. Only those that have some climb: after round ``r`` of pointer
doubling each knows its next ``2**r`` ancestors, so depth ``d`` takes about ``log2(d)``
equi-joins of that small part. Names and ranks travel inside the path. The scope is decided
on this part; all other nodes take the path of their parent in one join, and outside
of the scope they never get one.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.expr import words
from ..functions.names import species_key
from ..session import cut_lineage

_STEP = "struct<TaxId:string,ScientificName:string,Rank:string>"


def parse_nodes(fields: DataFrame) -> DataFrame:
    """``taxid, parent, rank`` of a nodes file; the last line of an id counts."""
    f = F.col("fields")
    rows = fields.where((F.size(f) >= 3) & (f[0] != "")).select(
        f[0].alias("taxid"), f[1].alias("parent"), f[2].alias("rank"), "line_no"
    )
    last = F.max_by(F.struct("parent", "rank"), "line_no")
    return rows.groupBy("taxid").agg(last.alias("n")).select("taxid", "n.parent", "n.rank")


def parse_names(fields: DataFrame, capture: DataFrame) -> DataFrame:
    """Names of the captured ids: scientific name, alternates by class, authorities."""
    f = F.col("fields")
    rows = (
        fields.where(F.size(f) >= 4)
        .select(f[0].alias("taxid"), f[1].alias("name"), f[3].alias("name_class"), "line_no")
        .join(capture.select("taxid"), "taxid", "left_semi")
    )
    return bucket_names(rows)


def bucket_names(rows: DataFrame) -> DataFrame:
    """Group ``taxid, name, name_class, line_no`` into one row per id."""
    classes = ["scientific name", *V.ALTERNATE_CLASSES, "authority"]
    line = F.struct("line_no", "name", "name_class")
    # one list for all classes: a single buffer for each id
    lines = rows.where(F.col("name_class").isin(classes)).groupBy("taxid").agg(
        F.sort_array(F.collect_list(line)).alias("lines")
    )

    def listed(name_class):
        return F.transform(F.filter("lines", lambda x: x["name_class"] == name_class), lambda x: x["name"])

    named = lines.select(
        "taxid",
        F.try_element_at(listed("scientific name"), F.lit(-1)).alias("scientific_name"),
        *[listed(c).alias(field) for c, field in V.ALTERNATE_CLASSES.items()],
        listed("authority").alias("Authority"),
    )
    return named


def parse_merged(fields: DataFrame, in_scope: DataFrame) -> DataFrame:
    """Former ids of every id in scope, in file order."""
    f = F.col("fields")
    rows = (
        fields.where((F.size(f) >= 2) & (f[0] != ""))
        .select(f[0].alias("old"), f[1].alias("taxid"), "line_no")
        .join(in_scope.select("taxid"), "taxid", "left_semi")
    )
    return group_merged(rows)


def group_merged(rows: DataFrame) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("line_no", "old")))
    return rows.groupBy("taxid").agg(F.transform(listed, lambda x: x["old"]).alias("merged"))


def _climbs() -> Column:
    return (F.col("parent") != F.col("taxid")) & (F.col("parent") != "")


def _step() -> Column:
    return F.struct(
        F.col("taxid").alias("TaxId"),
        F.coalesce("scientific_name", F.lit("")).alias("ScientificName"),
        F.col("rank").alias("Rank"),
    )


def inner_paths(nodes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``taxid, step, path`` of the nodes that have children: own entry and ancestors, parent first.

    A path ends at a node that is its own parent or whose parent is no node. ``names``
    supplies ``taxid, scientific_name`` for the entries. Raises ``ValueError`` on a cycle.
    """
    parents = nodes.where(_climbs()).select(F.col("parent").alias("taxid")).distinct()
    inner = nodes.join(parents, "taxid", "left_semi")
    if names is None:
        named = inner.withColumn("scientific_name", F.lit(None).cast("string"))
    else:
        some = names.select("taxid", "scientific_name").join(inner.select("taxid"), "taxid", "left_semi")
        named = inner.join(some, "taxid", "left")
    own = cut_lineage(
        named.select("taxid", _step().alias("step"), F.when(_climbs(), F.col("parent")).alias("next"))
    )
    above = own.select(F.col("taxid").alias("next"), F.array("step").alias("path"))
    none = F.array().cast(f"array<{_STEP}>")
    # a parent that is no node ends the path
    paths = cut_lineage(
        own.join(above, "next", "left").select(
            "taxid",
            "step",
            F.coalesce("path", none).alias("path"),
            F.when(F.col("path").isNotNull(), F.col("next")).alias("next"),
        )
    )
    while _unfinished(paths):
        paths = cut_lineage(_double(paths))
    return paths.drop("next")


def _line() -> Column:
    """Path of a node from its parent's entry and path, empty without a parent."""
    none = F.array().cast(f"array<{_STEP}>")
    return F.when(F.col("step").isNotNull(), F.concat(F.array("step"), "path")).otherwise(none)


def _below(nodes: DataFrame, inner: DataFrame, how: str) -> DataFrame:
    """Nodes with the path of their parent in front of it."""
    of_parent = inner.select(F.col("taxid").alias("_parent"), "step", "path")
    hit = (F.col("parent") == F.col("_parent")) & _climbs()
    return nodes.join(of_parent, hit, how).select(*nodes.columns, _line().alias("path"))


def ancestry(nodes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Add ``path`` to all nodes: the ancestors of each, parent first, up to the top."""
    return _below(nodes, inner_paths(nodes, names), "left")


def scoped(nodes: DataFrame, inner: DataFrame, roots) -> DataFrame:
    """Nodes that are one of ``roots`` or below one, with their paths."""
    wanted = F.array(*[F.lit(r) for r in sorted(roots)])
    own = F.concat(F.array(F.col("step.TaxId")), path_ids())
    below = _below(nodes, inner.where(F.arrays_overlap(own, wanted)), "inner")
    # roots that are not below another one
    tops = _below(nodes.where(F.col("taxid").isin(sorted(roots))), inner, "left")
    return below.unionByName(tops.where(~F.arrays_overlap(path_ids(), wanted)))


def _unfinished(paths: DataFrame) -> bool:
    """True while some path goes on; a node that is its own ancestor is an error."""
    state = paths.where("next is not null").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.array_contains(path_ids(), F.col("taxid"))).alias("cycle")
    ).first()
    if state["cycle"]:
        raise ValueError("the parents of the taxonomy form a cycle")
    return state["n"] > 0


def _double(paths: DataFrame) -> DataFrame:
    onward = paths.select(
        F.col("taxid").alias("next"), F.col("path").alias("more"), F.col("next").alias("after")
    )
    kept = [c for c in paths.columns if c not in ("path", "next")]
    # finished paths stay out of the join: their null pointers would all meet in one task
    moved = paths.where("next is not null").join(onward, "next").select(
        *kept, F.concat("path", "more").alias("path"), F.col("after").alias("next")
    )
    return paths.where("next is null").select(*moved.columns).unionByName(moved)


def path_ids(path="path") -> Column:
    return F.transform(path, lambda s: s["TaxId"])


def in_scope(tree: DataFrame, roots) -> DataFrame:
    """Nodes that are one of ``roots`` or below one."""
    wanted = F.array(*[F.lit(r) for r in sorted(roots)])
    line = F.concat(F.array("taxid"), path_ids())
    return tree.where(F.arrays_overlap(line, wanted))


def ancestors_of_roots(tree: DataFrame, roots, nodes: DataFrame | None = None) -> DataFrame:
    """Ids strictly above the roots, with a parent that is no node at the top.

    ``tree`` needs the rows of the roots only, if ``nodes`` has all nodes.
    """
    top = F.try_element_at("path", F.lit(-1))["TaxId"]
    chain = tree.where(F.col("taxid").isin(sorted(roots))).select(
        path_ids().alias("ids"), F.coalesce(top, F.col("taxid")).alias("last")
    )
    above = (
        chain.select("last")
        .distinct()
        .join((tree if nodes is None else nodes).select(F.col("taxid").alias("last"), "parent"), "last")
        .where((F.col("parent") != "") & (F.col("parent") != F.col("last")))
        .select(F.col("parent").alias("taxid"))
    )
    return chain.select(F.explode("ids").alias("taxid")).unionByName(above).distinct()


def lineage_steps() -> Column:
    """Path from the top to the parent, cut below id ``1``.

    A node that is its own parent is its own lineage, unless it is id ``1``.
    """
    cut = F.array_position(path_ids(), "1")
    kept = F.when(cut > 0, F.slice("path", F.lit(1), (cut - 1).cast("int"))).otherwise(F.col("path"))
    own = F.struct(
        F.col("taxid").alias("TaxId"),
        F.coalesce("scientific_name", F.lit("")).alias("ScientificName"),
        F.col("rank").alias("Rank"),
    )
    looped = (F.col("parent") == F.col("taxid")) & (F.col("taxid") != "1")
    return F.when(looped, F.array(own)).otherwise(F.reverse(kept))


def build_records(scope: DataFrame, names: DataFrame, merged: DataFrame) -> DataFrame:
    """Nested record per id in scope that has a scientific name."""
    rows = (
        scope.join(names, "taxid")
        .where(F.col("scientific_name").isNotNull() & (F.col("scientific_name") != ""))
        .join(merged, "taxid", "left")
        .withColumn("steps", lineage_steps())
    )
    nothing = F.array().cast("array<string>")
    authorities = F.transform(
        "Authority", lambda a: F.struct(F.lit("authority").alias("ClassCDE"), a.alias("DispName"))
    )
    shown = F.filter(F.transform("steps", lambda s: s["ScientificName"]), lambda n: n != "")
    record = F.struct(
        F.col("taxid").alias("TaxId"),
        F.col("scientific_name").alias("ScientificName"),
        F.col("parent").alias("ParentTaxId"),
        F.col("rank").alias("Rank"),
        F.struct(*V.ALTERNATE_CLASSES.values(), authorities.alias("Name")).alias("OtherNames"),
        F.array_join(shown, "; ").alias("Lineage"),
        F.col("steps").alias("LineageEx"),
        nothing.alias("AkaTaxIds"),
        F.sort_array(F.array_distinct(F.coalesce("merged", nothing))).alias("MergedTaxIds"),
    )
    return rows.select("taxid", record.alias("record"))


#: Bits of a place in an order, below the priority of a key.
_PLACE_BITS = 58


def id_places(ids: DataFrame) -> DataFrame:
    """``ids`` with ``as_text, as_number``: the place of each id in two orders, as ascending numbers.

    The second order has whole numbers first, by value. Sorted tables are numbered by partition
    and row, so no task sees all ids.
    """
    number = F.when(F.col("taxid").rlike(r"(?U)^\d+$"), F.col("taxid").try_cast("decimal(38,0)"))
    texts = ids.orderBy("taxid").withColumn("as_text", F.monotonically_increasing_id())
    numbers = ids.select("taxid", number.alias("number")).orderBy(F.col("number").asc_nulls_last(), "taxid")
    return texts.join(numbers.select("taxid", F.monotonically_increasing_id().alias("as_number")), "taxid")


def lookup_keys(records: DataFrame) -> DataFrame:
    """``key, taxid, scientific_name`` with one id per key.

    Scientific names win over alternates, alternates over species keys. Among equals
    the greatest id as text wins for scientific names and merged ids, the smallest as
    text for alternates, and the smallest number for species keys.

    Each claim on a key becomes one number, the priority and then the place of its id in the
    order that decides; the least one wins in a single hash aggregation, and ids are
    fetched for the winners.
    """
    r = F.col("record")
    name = r["ScientificName"]
    tax = lambda text: F.concat(F.lit("TAX::"), text)
    # the sorts read their input twice each: give them a narrow one
    places = cut_lineage(id_places(cut_lineage(records.select("taxid", name.alias("name")))))
    last = (1 << _PLACE_BITS) - 1

    def claim(key, priority, place):
        return F.struct(key.alias("key"), (F.lit(priority << _PLACE_BITS) + place).alias("code"))

    others = F.concat(*[r["OtherNames"][c] for c in V.ALTERNATE_CLASSES.values()])
    claims = records.select(
        "taxid",
        name.alias("name"),
        F.filter(others, lambda n: n != "").alias("others"),
        species_key(name).alias("clean"),
        ids_key(r["MergedTaxIds"]).alias("ids"),
    ).join(places.drop("name"), "taxid")
    differs = (F.col("clean") != F.col("name")) & (F.size(words(F.col("clean"))) >= 2)
    listed = F.concat(
        F.array(
            claim(tax(F.col("name")), 1, F.lit(last) - F.col("as_text")),
            claim(F.when(differs, tax(F.col("clean"))), 3, F.col("as_number")),
            claim(F.col("ids"), 1, F.lit(last) - F.col("as_text")),
        ),
        F.transform("others", lambda n: claim(tax(n), 2, F.col("as_text"))),
    )
    won = claims.select(F.inline(listed)).where(F.col("key").isNotNull()).groupBy("key").agg(F.min("code").alias("code"))
    place = F.col("code").bitwiseAND(last)
    priority = F.shiftright("code", _PLACE_BITS)
    winners = won.select(
        "key", (priority == 3).alias("numeric"), F.when(priority == 1, F.lit(last) - place).otherwise(place).alias("place")
    )
    ids = places.select(
        F.inline(
            F.array(
                F.struct(F.lit(False).alias("numeric"), F.col("as_text").alias("place"), "taxid", "name"),
                F.struct(F.lit(True).alias("numeric"), F.col("as_number").alias("place"), "taxid", "name"),
            )
        )
    )
    return winners.join(ids, ["numeric", "place"]).select("key", "taxid", F.col("name").alias("scientific_name"))


def ids_key(ids) -> Column:
    """Key of a set of ids, null for an empty one."""
    kept = F.sort_array(
        F.array_distinct(F.filter(F.transform(ids, lambda i: F.trim(i)), lambda i: i != ""))
    )
    return F.when(F.size(kept) > 0, F.concat(F.lit("IDS::"), F.array_join(kept, ",")))


def scientific_names(fields: DataFrame) -> DataFrame:
    """``taxid, scientific_name``; the last line of an id counts."""
    f = F.col("fields")
    rows = fields.where((F.size(f) >= 4) & (F.get(f, F.lit(3)) == "scientific name"))
    return rows.groupBy(f[0].alias("taxid")).agg(F.max_by(f[1], "line_no").alias("scientific_name"))


def compile_taxonomy(nodes_fields, names_fields, merged_fields, roots=None):
    """Records, keys and scope of all nodes below ``roots`` from the three dump files.

    The records feed several steps and are written out once.
    """
    roots = sorted(set(roots or V.DEFAULT_CLADES))
    nodes = cut_lineage(parse_nodes(nodes_fields))
    inner = inner_paths(nodes, scientific_names(names_fields))
    scope = cut_lineage(scoped(nodes, inner, roots))
    tops = _below(nodes.where(F.col("taxid").isin(roots)), inner, "left")
    capture = scope.select("taxid").unionByName(ancestors_of_roots(tops, roots, nodes)).distinct()
    records = cut_lineage(
        build_records(scope, parse_names(names_fields, capture), parse_merged(merged_fields, scope))
    )
    return records, lookup_keys(records), scope


def taxonomy_stats(records: DataFrame, keys: DataFrame, scope: DataFrame) -> DataFrame:
    """One row of counts."""
    names = records.select(F.count_distinct(F.col("record.ScientificName"))).scalar()
    return (
        keys.agg(
            F.count_if(F.startswith(F.col("key"), F.lit("TAX::"))).alias("tax_keys"),
            F.count_if(F.startswith(F.col("key"), F.lit("IDS::"))).alias("ids_keys"),
        )
        .withColumn("in_scope", scope.select(F.count(F.lit(1))).scalar())
        .withColumn("records", records.select(F.count(F.lit(1))).scalar())
        .withColumn("synonym_keys", F.col("tax_keys") - names)
        .select("in_scope", "records", "tax_keys", "synonym_keys", "ids_keys")
    )
