"""Documents that operators must cope with: a few given ones and all odd cases, with columns whose names could clash."""

import os

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, id long, kept string, score double, "
          "bits long, `group` int, packed binary, label int, hashes string, of long, drop string")
EXTRA = ("r", 9, "k", 0.5, 7, 3, b"p", 1, "h", 4, "d")


def texts(spark, n=120):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").limit(n)
             .select("doc_id", "text").collect()]
    first = given[0][1]
    passage = " ".join(f"passage{i}" for i in range(60))
    return given + [
        (1000, None), (1001, ""), (1002, " \t\n\x0b "), (1003, "one"), (1004, "one two"), (1005, first), (1006, first),
        (1007, "start here " + passage + " end there"), (1008, "another " + passage), (1009, passage + " tail"),
        (1010, " ".join(f"w{i % 977}" for i in range(40_000))), (1011, "Ünï çödé ßtraße\nSame Line Here\n\n same line here \n"),
        (1012, "same line here\nSAME LINE HERE\t\nshort\nshort"), (1012, "same line here\nSAME LINE HERE\t\nshort\nshort"),
        (1013, "x" * 50_000), (1014, "a\r\nb\x85c d"), (-5, "negative id holds SAME line here"), (-6, "Same Line Here"),
        (None, "Same Line Here"), (None, None),
    ]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), *EXTRA) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)
