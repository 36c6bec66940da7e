import json
import tarfile

import pytest
from pyspark.sql import functions as F

from binomia.operators import lookup, taxonomy
from binomia.plans.runs import compile_dump
from binomia.sources import dump

ROOTS = ["2", "2157"]


def read(spark, folder):
    return [dump.read_dump(spark, str(folder / f"{n}.dmp")) for n in ("nodes", "names", "merged")]


def ids(df):
    return {r["taxid"] for r in df.select("taxid").collect()}


def test_scope_and_ancestors(spark, dump_folder):
    nodes = taxonomy.parse_nodes(read(spark, dump_folder)[0])
    assert nodes.count() == 10
    tree = taxonomy.ancestry(nodes)
    assert ids(taxonomy.in_scope(tree, ROOTS)) == {"2", "909656", "821", "2157", "2172", "2173"}
    assert ids(taxonomy.ancestors_of_roots(tree, ROOTS)) == {"131567", "1"}


def test_odd_trees(spark):
    rows = [("5", "5", "x"), ("6", "5", "x"), ("7", "99", "x"), ("8", "7", "x"), ("9", "", "x")]
    nodes = spark.createDataFrame(rows, "taxid string, parent string, rank string")
    tree = taxonomy.ancestry(nodes)
    assert ids(taxonomy.in_scope(tree, ["5", "99"])) == {"5", "6"}
    assert ids(taxonomy.ancestors_of_roots(tree, ["8"])) == {"7", "99"}
    lines = tree.withColumn("scientific_name", F.lit("n")).select("taxid", taxonomy.lineage_steps().alias("s"))
    got = {r["taxid"]: [s["TaxId"] for s in r["s"]] for r in lines.collect()}
    assert got == {"5": ["5"], "6": ["5"], "7": [], "8": ["7"], "9": []}


def test_deep_chain_and_cycle(spark):
    chain = spark.range(1, 301).select(
        F.col("id").cast("string").alias("taxid"),
        F.greatest(F.col("id") - 1, F.lit(1)).cast("string").alias("parent"), F.lit("r").alias("rank"),
    )
    longest = taxonomy.ancestry(chain).agg(F.max(F.size("path"))).first()[0]
    assert longest == 299
    loop = spark.createDataFrame([("a", "b", ""), ("b", "a", ""), ("c", "a", "")], "taxid string, parent string, rank string")
    with pytest.raises(ValueError):
        taxonomy.ancestry(loop)


def test_records(spark, dump_folder):
    records, keys, scope = taxonomy.compile_taxonomy(*read(spark, dump_folder), ROOTS)
    r = records.where("taxid = '821'").first()["record"]
    assert r["OtherNames"]["Synonym"] == ["Bacteroides vulgatus"]
    assert r["MergedTaxIds"] == ["76856"]
    assert r["Lineage"] == "cellular organisms; Bacteria; Phocaeicola"
    assert {k["key"] for k in keys.collect()} >= {
        "TAX::Phocaeicola vulgatus", "TAX::Bacteroides vulgatus", "TAX::Methanobrevibacter smithii", "IDS::76856",
    }
    assert keys.where("key = 'TAX::Homo sapiens'").isEmpty()
    assert taxonomy.taxonomy_stats(records, keys, scope).first().asDict() == {
        "in_scope": 6, "records": 6, "tax_keys": 7, "synonym_keys": 1, "ids_keys": 1,
    }


def record_table(spark, *rows):
    """Records from (taxid, scientific name, synonyms, merged)."""
    df = spark.createDataFrame(
        [(t, t, n, s, m) for t, n, s, m in rows], "taxid string, i string, n string, s array<string>, m array<string>"
    )
    none = F.array().cast("array<string>")
    shown = F.array().cast("array<struct<ClassCDE:string,DispName:string>>")
    other = F.struct(F.col("s").alias("Synonym"), none.alias("GenbankSynonym"), none.alias("EquivalentName"),
                     none.alias("Includes"), shown.alias("Name"))
    steps = F.array().cast("array<struct<TaxId:string,ScientificName:string,Rank:string>>")
    return df.select("taxid", F.struct(
        F.col("i").alias("TaxId"), F.col("n").alias("ScientificName"), F.lit("").alias("ParentTaxId"),
        F.lit("species").alias("Rank"), other.alias("OtherNames"), F.lit("").alias("Lineage"),
        steps.alias("LineageEx"), none.alias("AkaTaxIds"), F.col("m").alias("MergedTaxIds")).alias("record"))


def keys_of(records):
    return {r["key"]: r["taxid"] for r in taxonomy.lookup_keys(records).collect()}


def test_key_priority(spark):
    got = keys_of(record_table(
        spark,
        ("821", "Phocaeicola vulgatus", [], []),
        ("999", "Other species", ["Phocaeicola vulgatus"], []),
        ("9", "Nine a", ["Shared name"], []),
        ("10", "Ten a", ["Shared name"], ["5", "40"]),
        ("300", "Ruminococcus bicirculans (ex Liu et al. 2021)", [], []),
        ("1200", "Ruminococcus bicirculans (ex Wegman et al. 2014)", [], []),
        ("222", "Real binomial (ex Liu et al. 2021)", [], []),
        ("333", "Real binomial", [], []),
    ))
    assert got["TAX::Phocaeicola vulgatus"] == "821"
    assert got["TAX::Shared name"] == "10"
    assert got["TAX::Ruminococcus bicirculans"] == "300"
    assert got["TAX::Real binomial"] == "333"
    assert got["IDS::40,5"] == "10"


def find(spark, records, *names):
    found = lookup.from_taxonomy(records, taxonomy.lookup_keys(records))
    wanted = spark.createDataFrame([(n,) for n in names], "taxon string")
    return {r["taxon"]: r["rec_id"] for r in lookup.find_records(wanted, found.keys).collect()}


def test_lookup_spellings(spark):
    records = record_table(
        spark,
        ("1263", "Ruminococcus", [], []),
        ("2364881", "Ruminococcus bicirculans (ex Wegman et al. 2014)", [], []),
        ("562", "Escherichia coli", [], []),
        ("561", "Escherichia", [], []),
    )
    assert find(
        spark, records, "Ruminococcus bicirculans ex Wegman et al 2014", "Ruminococcus", "Escherichia coli",
        "Escherichia coli K12X", "Nobody here",
    ) == {
        "Ruminococcus bicirculans ex Wegman et al 2014": "2364881",
        "Ruminococcus": "1263",
        "Escherichia coli": "562",
        "Escherichia coli K12X": "561",
    }


def test_archive_and_missing(spark, dump_folder, tmp_path):
    names = "".join(f"{k}\t|\tname {k} \u00e9\t|\t\t|\tscientific name\t|\n" for k in range(120_000))
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "names.dmp").write_text(names)
    (tmp_path / "big" / "nodes.dmp").write_text("")
    archive = tmp_path / "dump.tar.gz"
    with tarfile.open(archive, "w:gz") as tar:
        tar.add(dump_folder, arcname="deep/path")
    small = dump.resolve_dump(spark, f"file://{archive}", f"file://{tmp_path}/work")
    for name in dump.DUMP_FILES:
        rows, plain = (dump.read_dump(spark, f"{f}/{name}").orderBy("line_no") for f in (small, dump_folder))
        assert [r.fields for r in rows.collect()] == [r.fields for r in plain.collect()]
    with tarfile.open(archive, "w:gz") as tar:
        tar.add(dump_folder, arcname="first")  # the later member of a name counts
        tar.add(tmp_path / "big", arcname="later")
    folder = dump.resolve_dump(spark, archive)
    rows = dump.read_dump(spark, f"{folder}/names.dmp").orderBy("line_no").collect()
    assert [r.fields[1] for r in rows] == [f"name {k} \u00e9" for k in range(120_000)]
    with pytest.raises(FileNotFoundError):
        dump.resolve_dump(spark, tmp_path / "none")


def test_compile_from_archive(spark, dump_folder, tmp_path):
    archive = tmp_path / "dump.tgz"
    with tarfile.open(archive, "w:gz") as tar:
        tar.add(dump_folder, arcname="x")
    packed = compile_dump(spark, f"file://{archive}", f"file://{tmp_path}/a", work_dir=f"file://{tmp_path}/work")
    plain = compile_dump(spark, str(dump_folder), f"file://{tmp_path}/b")
    for stats in (packed, plain):
        del stats["output"], stats["bytes"]
    assert packed == plain


def test_compile_and_import(spark, dump_folder, tmp_path):
    out = str(tmp_path / "lookup")
    stats = compile_dump(spark, str(dump_folder), out, as_json=True)
    assert stats["ids_keys"] == 1 and stats["bytes"] > 0
    from binomia.sources.sinks import read_document

    text = read_document(f"{out}/lookup_json")
    assert "TAX::Bacteroides vulgatus" in json.loads(text)
    single = tmp_path / "lookup.json"
    single.write_text(text, encoding="utf-8")
    stored, imported = dump.load_lookup(spark, out), dump.load_lookup(spark, str(single))
    folder = dump.load_lookup(spark, f"{out}/lookup_json")
    assert sorted(folder.keys.select("key", "ord").collect()) == sorted(stored.keys.select("key", "ord").collect())
    assert stored.keys.count() == imported.keys.count() == 8


def test_foreign_and_missing_lookups(spark, tmp_path):
    record = {
        "ScientificName": "Foo bar", "TaxId": "1", "Rank": "species",
        "OtherNames": {"Synonym": "Foo old", "Name": ["Foo seen", {"ClassCDE": "x", "DispName": "Foo shown 1"}]},
    }
    path = tmp_path / "l.json"
    path.write_text(json.dumps({"TAX::Foo bar": [record]}))
    pools = lookup.record_pools(dump.import_lookup(spark, str(path))).first()
    assert pools["synonyms"] == ["Foo bar", "Foo old", "Foo seen", "Foo shown"]
    path.write_text("{broken")
    assert dump.import_lookup(spark, str(path)).keys.count() == 0
    assert dump.load_lookup(spark, str(tmp_path / "nothing")).keys.count() == 0


def test_keys_carry_the_name_of_their_record(spark, dump_folder):
    """So a lookup is made without a second join of all keys with the records."""
    records, keys, _ = taxonomy.compile_taxonomy(*read(spark, dump_folder), ROOTS)
    names = {r["taxid"]: r["name"] for r in records.select("taxid", "record.ScientificName").toDF("taxid", "name").collect()}
    rows = keys.collect()
    assert rows and all(names[r["taxid"]] == r["scientific_name"] for r in rows)
