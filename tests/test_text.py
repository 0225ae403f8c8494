import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tideline.functions import text


def one(spark, function, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(function(*[F.col(n) for n in names]).alias("x")).first()[0]


def many(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v")).alias("x")).collect()]


NOISE = {
    "blank runs": lambda s, n: "\t".join(s.split()) + " \u00a0",
    "mixed case": lambda s, n: "".join(c.upper() if i % 3 == n % 3 else c for i, c in enumerate(s)),
    "wide accents": lambda s, n: s.replace("o", "\u014d").replace("a", "\u1ea3").replace("i", "\u012d"),
    "combining marks": lambda s, n: "".join(c + "\u0323" if c in "lrt" else c for c in s),
    "full width": lambda s, n: "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalpha() else c for c in s),
    "signs between": lambda s, n: s.replace(" ", ("/", "_", " & ", "·")[n % 4]),
    "remark in front": lambda s, n: f"(lot {n}) {s}",
    "code in front": lambda s, n: f"{n % 900 + 10} {s}",
    "code behind": lambda s, n: f"{s} {n % 90}",
    "hash code inside": lambda s, n: s.replace(" ", f" #{n % 9} ", 1),
}


def test_shade_noise_in_any_combination(spark):
    """Every label, under one kind of noise and under several at once, has one normal form."""
    pick = random.Random(11)
    given, expected = [], []
    for label in ("Tall Orchid", "salt trail", "Alto Coral Tint"):
        for _ in range(150):
            text_ = label
            kinds = pick.sample(sorted(set(NOISE) - {"code in front", "code behind", "full width"}), pick.randint(0, 4))
            for kind in [*kinds, *pick.choice([[], ["code in front"], ["code behind"], ["full width"]])]:
                text_ = NOISE[kind](text_, pick.randrange(1, 1000))
            given.append(text_)
            expected.append(label.lower())
    assert many(spark, text.normalize_shade, given) == expected


def test_shades_that_are_codes_only(spark):
    given = {"88": "88", "#44": "44", "No 9": "no", " \t ": "", "(all of it)": "all of it", "¾ plum": "3 4 plum", "7 8 9 jade": "7 8 9 jade"}
    assert many(spark, text.normalize_shade, list(given)) == list(given.values())


def test_shade_at_the_end_of_a_name(spark):
    given = {
        "Velvet Cream 245 Warm Copper Dust": "245 Warm Copper Dust", "Tint 12 Plum\u00a0": "12 Plum", "Polish (no 44)": "no 44",
        "Base 1234 Ivory": "234 Ivory", "Kit of six": None, "Stick # 305": "# 305", "Stick 31 plum": None, "44 Grey-Blue L'Eau": "44 Grey-Blue L'Eau",
    }
    assert many(spark, text.extract_shade, list(given)) == list(given.values())


@pytest.mark.parametrize("given, expected", [
    ("INCI : Cera Alba; Eau†‡", ["beeswax", "water"]),
    ("Alcohol 12,5%", ["alcohol 12"]),
    ("Oil (sun, flower), x", ["oil sun", "flower"]),
    ("ingrédients: CI77491•ci 77491\nTalc -", ["ci 77491", "talc"]),
    ("Glycerin，Talc", ["glycerin talc"]),
    ("a／b/cc", ["a/b", "cc"]),
    ("Vitamin  E 3.5 % , -Mica-", ["vitamin e", "mica"]),
    ("", []),
])
def test_ingredient_rules(spark, given, expected):
    assert one(spark, text.split_ingredients, given) == expected


def test_single_ingredient(spark):
    assert many(spark, text.normalize_ingredient, ["Aqua", "CI77491", "Parfum (x)", "Huile d'Olive 2%"]) == [
        "water", "ci 77491", "fragrance", "huile d olive"]


def test_long_runs_stay_linear(spark):
    given = "-" * 50_000 + " " * 50_000 + ".," * 20_000
    assert one(spark, text.split_ingredients, given) == []


def test_product_keys(spark):
    keys = {one(spark, text.product_key, brand, name) for brand, name in (
        ("Maison Öre, Öre Group", "Crème d'été No5"), ("MAISON ORE", "creme  D ETE   nO5"), ("maison-öre,", "Cre\u0300me d’été No5"))}
    assert keys == {"maison ore|creme d ete no5"}
    assert one(spark, text.normalize_brand, "St. Ives' & Co, Else") == "st ives co"


def test_folding_agrees_with_unicode(spark):
    """Characters that decompose or combine, next to letters: the JVM fold and the full fold give the same words."""
    chars = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF
             and (unicodedata.combining(chr(c)) or unicodedata.decomposition(chr(c)) or c % 97 == 0)]
    given = [f"ab{c}x {c}" for c in chars]

    def full(value):
        return "".join(ch for ch in unicodedata.normalize("NFKD", value) if not unicodedata.combining(ch))

    df = spark.createDataFrame([(v,) for v in given], "v string")
    rows = df.select("v", F.regexp_replace(F.lower(text.fold_to_ascii(F.col("v"))), "[^a-z0-9]+", " "),
                     text.fold_accents("v")).collect()
    assert len(rows) == len(chars) > 5000
    for value, words, folded in rows:
        assert folded == full(value)
        assert words == re.sub("[^a-z0-9]+", " ", full(value).lower())


def test_categories(spark):
    given = {"en:cosmetics,en:makeup,en:lipstick": "lipstick", "": "makeup", "en:makeup,en:soap": "makeup",
             "fr:vernis": "vernis", "en:creams": "makeup"}
    assert many(spark, text.best_category, list(given)) == list(given.values())
