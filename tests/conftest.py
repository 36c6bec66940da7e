import pytest

from binomia.session import local_session

NODES = [
    ("1", "1", "no rank"), ("131567", "1", "no rank"), ("2", "131567", "superkingdom"),
    ("2157", "131567", "superkingdom"), ("2759", "131567", "superkingdom"),
    ("909656", "2", "genus"), ("821", "909656", "species"), ("2172", "2157", "genus"),
    ("2173", "2172", "species"), ("9606", "2759", "species"),
]
NAMES = [
    ("1", "root", "", "scientific name"),
    ("131567", "cellular organisms", "", "scientific name"),
    ("2", "Bacteria", "", "scientific name"),
    ("2157", "Archaea", "", "scientific name"),
    ("2759", "Eukaryota", "", "scientific name"),
    ("909656", "Phocaeicola", "", "scientific name"),
    ("821", "Phocaeicola vulgatus", "", "scientific name"),
    ("821", "Bacteroides vulgatus", "", "synonym"),
    ("821", "Bacteroides vulgatus (Eggerth and Gagnon 1933)", "", "authority"),
    ("2172", "Methanobrevibacter", "", "scientific name"),
    ("2173", "Methanobrevibacter smithii", "", "scientific name"),
    ("9606", "Homo sapiens", "", "scientific name"),
]
MERGED = [("76856", "821")]


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def dump_folder(tmp_path):
    folder = tmp_path / "dump"
    folder.mkdir()
    for name, rows in (("nodes", NODES), ("names", NAMES), ("merged", MERGED)):
        text = "".join("\t|\t".join(r) + "\t|\n" for r in rows)
        (folder / f"{name}.dmp").write_text(text, encoding="utf-8")
    return folder


@pytest.fixture
def evaluate(spark):
    """Apply Column functions to a list of texts; returns a list of tuples."""

    def run(values, *functions, kind="string"):
        from pyspark.sql import functions as F

        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, v {kind}").coalesce(1)
        out = df.select("i", *[f(F.col("v")).alias(f"c{n}") for n, f in enumerate(functions)])
        return [tuple(r)[1:] for r in out.orderBy("i").collect()]

    return run
