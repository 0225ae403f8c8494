import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import text
from tideline.operators import agreement, catalog, refresh
from tideline.sources import catalog_files, dimensions
from tideline.tables import CATALOG_EXPORT

HEADER = "code\turl\tproduct_name\tbrands\tcategories_tags\tingredients_text"
ROWS = [
    '00000000003\tu\tMascara  Noir \t"Lumière, Other"\ten:makeup,en:mascara\t' + '"Aqua, ""Mica"" 2%,\n Parfum"',
    "00000000001\tu\tFoundation SPF 30 245 Amber Rose\tPetal Lab\t\t" + "Talc, " * 1000 + "Kaolin",
    "00000000002\tu\tEye makeup remover\tPetal Lab\ten:makeup\t",
    "00000000004\tu\tLip balm\t  \ten:lip-balm\tWax",
    "00000000005\tu\tVernis (No. 37)\tDune & Co\tfr:vernis\t",
    "00000000006\tu\tSoap\tDune & Co\ten:soaps\t",
]


def export(spark, tmp_path):
    path = tmp_path / "export.csv.gz"
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write("\n".join([HEADER, *ROWS]) + "\n")
    return catalog_files.product_export(spark, str(path))


def test_export_to_catalog(spark, tmp_path):
    table = export(spark, tmp_path)
    assert table.count() == 6
    built = catalog.catalog_build(table)
    rows = built.collect()
    assert [r["code"] for r in rows] == ["00000000001", "00000000003", "00000000005"]
    assert [r["category"] for r in rows] == ["makeup", "mascara", "vernis"]
    assert rows[0]["ingredients_text"] == "Talc, " * 1000 + "Kaolin" and rows[1]["ingredients_text"] == 'Aqua, "Mica" 2%,\n Parfum'
    assert rows[1]["name"] == "Mascara  Noir"
    listed = built.where("code = '00000000001'").select(text.split_ingredients(F.col("ingredients_text")).alias("x")).first()["x"]
    assert listed == ["talc", "kaolin"]
    assert catalog.catalog_build(table, max_chars=20).collect()[0]["ingredients_text"] == "Talc, Talc, Talc, Ta"

    folder = str(tmp_path / "extract")
    catalog_files.write_extract(built, folder)
    part = next((tmp_path / "extract").glob("*.json.gz"))
    assert json.loads(gzip.open(part, "rt", encoding="utf-8").readline())["code"] == "00000000001"
    numbered = catalog.catalog_ids(catalog_files.read_extract(spark, folder)).orderBy("product_id").collect()
    assert [(r["product_id"], r["shade_id"], r["shade_name"]) for r in numbered] == [
        (1, 10, "245 Amber Rose"), (2, 20, "unspecified"), (3, 30, "No. 37")]


def test_load_and_refresh(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "dims")
    assert dimensions.read_table(spark, root, "shades").count() == 0
    catalog_files.load_catalog(spark, catalog.catalog_build(export(spark, tmp_path)), root)
    products = dimensions.read_table(spark, root, "products").orderBy("product_id").collect()
    assert [p["ingredients_text"] is None for p in products] == [False, False, True]
    assert all(p["canonical_key"] is None for p in products)

    report = dimensions.refresh(spark, root).first().asDict()
    assert report == {"shades": 3, "distinct_canonical_shades": 3, "products": 3, "distinct_products": 3,
                      "ingredient_rows": 5, "distinct_ingredients": 5}
    keys = [r[0] for r in dimensions.read_table(spark, root, "products").orderBy("product_id").select("canonical_key").collect()]
    assert keys[1] == "lumiere|mascara noir"
    names = dimensions.read_table(spark, root, "product_ingredients").where("product_id = 2").orderBy("position").collect()
    assert [(r["position"], r["normalized"]) for r in names] == [(0, "water"), (1, "mica"), (2, "fragrance")]
    assert dimensions.current_version(spark, root) == 2

    # a refresh that breaks off leaves the last version in place
    def broken(products):
        raise RuntimeError("lost")

    monkeypatch.setattr(refresh, "product_ingredients", broken)
    try:
        dimensions.refresh(spark, root)
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert dimensions.current_version(spark, root) == 2
    assert dimensions.refresh(spark, root).first().asDict() == report


def test_duplicate_products(spark):
    rows = [(1, "Maison Été, Atelier Sud", "Crème légère dorée"), (2, "maison été", "CREME  LEGERE DOREE"), (3, "x", "y")]
    table = refresh.refresh_products(spark.createDataFrame(rows, "product_id int, brand string, raw_name string"))
    assert [tuple(r) for r in refresh.duplicate_products(table).collect()] == [("maison ete|creme legere doree", 2)]
    assert table.where(F.col("refreshed_at").isNull()).count() == 0


def multi_line(spark, path):
    reader = spark.read.option("sep", "\t").option("header", "true").option("quote", '"').option("escape", '"').option("maxCharsPerColumn", "-1")
    return reader.option("multiLine", "true").csv(path).select(*CATALOG_EXPORT)


@pytest.fixture
def small_pieces(spark):
    before = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for name, value in zip(before, ("2000", "1")):
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_quoted_records_over_many_pieces(spark, tmp_path, small_pieces):
    """Line ends, tabs and quotes in fields, short pieces: a record may begin in one, cross some and end in another."""
    rng = random.Random(7)
    fields = ["", "plain", 'an inch 5" wide', '"quoted"', '"with\ttab"', '"two\nlines"', '"""all"""', '"a ""b"" c\n\n""d"""', '""', ' " spaced ', "Ünï", '"x\r\ny"']
    for file in range(3):
        with open(tmp_path / f"part{file}.csv", "w", encoding="utf-8", newline="") as out:
            out.write(HEADER + "\n")
            for i in range(400):
                row = [f"{file}-{i}", "u", *[rng.choice(fields) for _ in range(3)], rng.choice([*fields, '"' + "long\n" * rng.randrange(1, 1500) + '"'])]
                out.write("\t".join(row) + "\n" + "\n" * (i % 50 == 0))
    path = str(tmp_path)
    got = catalog_files.product_export(spark, path)
    assert got.rdd.getNumPartitions() > 50
    assert got.count() == 1200 and agreement.agree(got, multi_line(spark, path)).first()["identical"]


def test_exports_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "\n")
    assert catalog_files.product_export(spark, str(tmp_path)).count() == 0
    (tmp_path / "b.csv").write_text(HEADER + "\n1\tu\tn\tb\tt\t\"never closed\nby a quote")
    assert catalog_files.product_export(spark, str(tmp_path / "b.csv")).collect() == multi_line(spark, str(tmp_path / "b.csv")).collect()
