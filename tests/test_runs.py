import csv
import json
from pathlib import Path

import pytest

from binomia import cli
from binomia.functions import vocab as V
from binomia.operators.lookup import from_taxonomy
from binomia.operators.taxonomy import compile_taxonomy, parse_nodes
from binomia.plans.runs import map_file
from binomia.sources import dump, tables
from binomia.sources.sinks import read_document


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_query_columns(spark, tmp_path):
    path = write(tmp_path / "q.csv", "id,name,count\n1,Foo_bar ,1e-5\n2,NA,x\n3,Foo baz,\n")
    got = [(r["taxa_name"], r["abundance"]) for r in tables.read_queries(spark, path).orderBy("pos").collect()]
    assert got == [("Foo_bar ", 1e-05), ("nan", 0.0), ("Foo baz", 0.0)]
    path = write(tmp_path / "r.csv", "first,second\nA b,1\n")
    only = tables.read_queries(spark, path).first()
    assert (only["taxa_name"], only["abundance"]) == ("A b", None)


def test_rows_of_many_splits_keep_the_order_of_the_file(spark, tmp_path):
    lines = [f"n{k}\t|\tp{k}\t|\t{'x' * (k % 17)}\t|" for k in range(400)] + ["n3\t|\tlast\t|\tr\t|"]
    write(tmp_path / "nodes.dmp", "\n".join(lines) + "\n")
    write(tmp_path / "q.csv", "taxa_name,abundance\n" + "".join(f"name {k},{k}\n" for k in range(300)))
    folder = tmp_path / "parts"
    folder.mkdir()
    for k in range(3):
        write(folder / f"part-{k}.dmp", "".join(f"{k}_{i}\t|\tp\t|\tr\t|\n" for i in range(50)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        fields = dump.read_dump(spark, f"file://{tmp_path}/nodes.dmp")
        assert fields.rdd.getNumPartitions() > 20
        rows = fields.orderBy("line_no").collect()
        assert [r["fields"][0] for r in rows] == [f"n{k}" for k in range(400)] + ["n3"]
        assert len({r["line_no"] for r in rows}) == 401
        assert parse_nodes(fields).where("taxid = 'n3'").first()["parent"] == "last"
        queries = tables.read_queries(spark, str(tmp_path / "q.csv")).orderBy("pos").collect()
        assert [r["taxa_name"] for r in queries] == [f"name {k}" for k in range(300)]
        rows = dump.read_dump(spark, str(folder)).orderBy("line_no").collect()
        assert [r["fields"][0] for r in rows] == [f"{k}_{i}" for k in range(3) for i in range(50)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'taxa_name,abundance\n"Foo\nbar",1\n"a ""b"" c",2\n')
    got = [r["taxa_name"] for r in tables.read_queries(spark, path, multi_line=True).orderBy("pos").collect()]
    assert got == ["Foo\nbar", 'a "b" c']


def test_catalogue_suffix(spark, tmp_path):
    path = write(tmp_path / "m.csv", "Filename\nA_b.mat\nC_d.MAT\nE.mat.mat\n")
    got = [r["model"] for r in tables.read_catalogue(spark, path).orderBy("model_pos").collect()]
    assert got == ["A_b", "C_d.MAT", "E.mat"]


@pytest.fixture
def inputs(spark, dump_folder, tmp_path):
    parts = [dump.read_dump(spark, str(dump_folder / f"{n}.dmp")) for n in ("nodes", "names", "merged")]
    records, keys, _ = compile_taxonomy(*parts)
    dump.save_lookup(from_taxonomy(records, keys), str(tmp_path / "lookup"))
    names = ["Phocaeicola vulgatus ERR1", "Phocaeicola vulgatus", "Bacteroides vulgatus", "[Foo] bar, x", "Zzz yyy"]
    rows = "".join(f'"{n}",{i}\n' for i, n in enumerate(names))
    models = "Filename\nPhocaeicola_vulgatus_ERR1.mat\nFoo_bar_K12.mat\nOther_dorei.mat\n"
    return (
        write(tmp_path / "q.csv", "taxa_name,abundance\n" + rows),
        write(tmp_path / "m.csv", models),
        str(tmp_path / "lookup"),
    )


def read_rows(folder):
    parts = sorted(folder.glob("part-*.csv"))
    return [row for p in parts for row in csv.DictReader(p.open(encoding="utf-8"))]


def test_run_folder(spark, inputs, tmp_path):
    # a path with a scheme, as on shared storage
    folder = Path(map_file(
        spark, *inputs, output=f"file://{tmp_path}/out", name="x", report=True, plots=True
    ).removeprefix("file://"))
    stats = json.loads((folder / "debug" / "02_filtering_stats.json").read_text())
    assert stats["total_taxa"] == 4 and stats["auto_accepted"] == 1
    assert [r["taxa_name"] for r in read_rows(folder / "debug" / "00_input.csv")][3] == "[Foo] bar, x"
    matched = read_rows(folder / "debug" / "01_jaccard_raw.csv")
    assert list(matched[0])[:3] == ["taxa_name", "abundance", "taxon"]
    assert [r["taxa_name"] for r in matched] == [
        "Phocaeicola vulgatus ERR1", "Bacteroides vulgatus", "[Foo] bar, x", "Zzz yyy"]
    assert matched[0]["has_gs"] == "True" and matched[0]["bands"] == "auto-accept"
    assert matched[3]["n_candidates"] == "3" and matched[3]["mat_candidates_str"].count(";") == 2
    final = {r["taxa_name"]: r for r in read_rows(folder / "results" / "final_mapping.csv")}
    assert final["Bacteroides vulgatus"]["final_band"] == "yellow_green"
    assert final["Zzz yyy"]["suggested_gem"] == "no_suggestion"
    report = json.loads(read_document(folder / "results" / "mapping_report.json"))
    assert report["jobId"].startswith("x_") and report["total_bacteria"] == 4
    assert [i["status"] for i in report["results"]] == [
        "unambiguous", "high_similarity", "no_correspondence", "no_correspondence"]
    assert set(report["results"][0]) == {
        "query_name", "abundance", "mapped_id", "status", "confidence_score", "candidates"}
    page = read_document(folder / "debug_report.html")
    assert page.startswith("<!DOCTYPE html>") and page.endswith("</body></html>\n")
    assert page.index("Phocaeicola vulgatus ERR1") < page.index("Zzz yyy")
    assert "<td>Phocaeicola vulgatus ERR1</td></tr>" in page  # heir of the dropped name


def test_command_line(spark, inputs, tmp_path):
    q, m, lookup = inputs
    base = ["map", "--models", m, "--lookup", lookup, "--output", str(tmp_path / "o")]
    assert cli.main([*base, "--input", str(tmp_path / "none.csv")]) == 1
    assert cli.main([*base, "--input", q]) == 0
    assert cli.parser().parse_args(["compile", "--taxdump", "d", "--output", "o"]).clades == ",".join(V.DEFAULT_CLADES)
