import hashlib
import re

from tests.llm import odd
from tideline.llm import licenses
from tideline.llm.license_texts import NOTICES, SPELLINGS, TEXTS


def canonical(text):
    table = {ord(u): l for u, l in zip(licenses.UPPER + licenses.BLANKS, licenses.LOWER + " " * len(licenses.BLANKS), strict=True)}
    x = re.sub(licenses.COPYRIGHT_LINE, r"\1", (text or "").translate(table))
    x = re.sub(licenses.SIGNS, " ", x)
    for one, other in SPELLINGS:
        x = x.replace(one, other)
    return x


def test_documents(spark):
    mit, isc = TEXTS["MIT"], TEXTS["ISC"]
    rows = [*odd.texts(spark, 40), (5000, mit), (5001, "Copyright (c) 2001 Someone\n\n" + mit.upper().replace(". ", ".\n\n")),
            (5002, mit + " and more"), (5003, "© me\n" + isc.replace('"AS IS"', "“as is”")), (5004, isc + "\n" + isc),
            (5005, "text\n  * " + NOTICES["MIT"][0] + "\nmore\n" + NOTICES["GPL-3.0"][0].replace("License", "Licence")),
            (5005, NOTICES["MIT"][0])]
    got = licenses.scan(odd.documents(spark, rows), licenses.known(spark))
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())
    whole = {" ".join(canonical(t).split()): name for name, t in TEXTS.items()}
    lines = {" ".join(canonical(t).split()): name for name, ts in NOTICES.items() for t in ts}
    noted = {}
    for key, text in rows:
        noted.setdefault(key, set()).update({lines[x.strip(" ")] for x in canonical(text).split("\n") if x.strip(" ") in lines})
    want = sorted(((key, hashlib.sha256(re.sub("[ \n]+", " ", canonical(text)).strip(" ").encode()).hexdigest(),
                    whole.get(re.sub("[ \n]+", " ", canonical(text)).strip(" ")), ",".join(sorted(noted[key])) if key is not None else "")
                   for key, text in rows), key=repr)
    assert odd.rows_of(got) == want
    named = {r[0]: r[2] for r in want}
    assert [named[k] for k in (5000, 5001, 5002, 5003, 5004)] == ["MIT", "MIT", None, "ISC", None]
    assert licenses.scan(odd.empty(spark), licenses.known(spark)).count() == 0
    assert licenses.scan(odd.documents(spark, rows), licenses.known(spark).limit(0)).where("license is not null").count() == 0
