import re
from datetime import date

from pyspark.sql import functions as F

from codeloom.llm import pseudonyms as P


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 * (x > 4)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def run(docs, key="k"):
    return {r.doc_id: (r.text, r.found) for r in P.pseudonymise(docs, key).select("row.doc_id", "text", "found").collect()}


def test_permutation_and_inverse(spark):
    ids = spark.range(7 * 11)
    two = ids.select("id", P.feistel(F.col("id"), F.lit(7), F.lit(11), "k", "x").alias("y"))
    rows = two.select("id", "y", P.feistel(F.col("y"), F.lit(7), F.lit(11), "k", "x", inverse=True).alias("z")).collect()
    assert sorted(r.y for r in rows) == list(range(77)) and all(r.id == r.z for r in rows)
    big = spark.createDataFrame([("9" * 18,), ("0" * 18,), ("123456789012345678",), ("7",), ("42",)], "d string")
    for r in big.select("d", P.permuted_digits(F.col("d"), "k", "c").alias("p")).select("d", "p", P.permuted_digits(F.col("p"), "k", "c", inverse=True).alias("b")).collect():
        assert r.d == r.b and len(r.p) == len(r.d)


def test_formats_and_links(texts):
    card, spaced = "4111111111111111", "4111 1111 1111 1111"
    docs = texts(
        f"pay {card} now, or {spaced}.", f"again {card}!", "not a card 4111111111111112 or 12345678901234567890123",
        "call +1 (974) 555-3436 or +1 (974) 555-3437", "at 192.168.10.255 not 256.1.1.1 nor 1.2.3.4.5", "born 1987-02-28, 29.02.2000, 12/31/1999, not 2001-02-29",
        "ssn 123-45-6789 not 666-45-6789", "mail joe.doe@mail.example.com or JOE.DOE@mail.example.com", "hex 04dbebab91ab85687d33eeaaf9ac699e1188f962",
        "day 1987-02-28 again",
    )
    out = run(docs)
    one, two = re.findall(r"\d[\d ]{14,}\d", out[0][0])
    assert luhn(one) and one != card and two.replace(" ", "") == one and [len(x) for x in two.split()] == [4] * 4 and one in out[1][0]
    assert out[2] == ("not a card 4111111111111112 or 12345678901234567890123", [])
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[3][0])
    assert len(set(phones)) == 2 and "555-3436" not in out[3][0]
    assert out[4][1] == ["ip"] and out[4][0].endswith("not 256.1.1.1 nor 1.2.3.4.5") and "192.168.10.255" not in out[4][0]
    assert all(0 <= int(x) <= 255 for x in re.search(r"at ([\d.]+) not", out[4][0])[1].split("."))
    iso, dots, slash, wrong = re.search(r"born (\S+), (\S+), (\S+), not (\S+)", out[5][0]).groups()
    assert wrong == "2001-02-29" and date.fromisoformat(iso) and iso != "1987-02-28" and iso in out[9][0]
    d, m, y = map(int, dots.split("."))
    assert 1900 <= date(y, m, d).year <= 2099
    m, d, y = map(int, slash.split("/"))
    assert date(y, m, d)
    assert out[6][1] == ["ssn"] and out[6][0].endswith("not 666-45-6789") and re.match(r"ssn (?!000|666|9)\d{3}-\d{2}-\d{4} ", out[6][0])
    a, b = re.findall(r"\S+@\S+", out[7][0])
    assert a == b and "joe" not in a
    assert out[8] == (docs.collect()[8].text, [])
    assert run(docs) == out and run(docs, "other")[0] != out[0]


def test_odd(odd, none):
    rows = P.pseudonymise(odd, "k").select("row.doc_id", F.col("row.text").alias("old"), "text", "found").collect()
    assert len(rows) == odd.count() and all(r.text == (r.old or "") and not r.found for r in rows)
    assert P.pseudonymise(none, "k").count() == 0


def test_given_tables(sf):
    rows = P.pseudonymise(sf("documents", "sf0.01"), "k").select(F.col("row.text").alias("old"), "text", "found").collect()
    pattern = re.compile(r"(?<![A-Za-z0-9_.+-])\d{16}(?![A-Za-z0-9_])")
    cards = 0
    for r in rows:
        old, new = pattern.findall(r.old), pattern.findall(r.text)
        assert len(old) == len(new) and all((a != b) == luhn(a) and luhn(a) == luhn(b) for a, b in zip(old, new))
        cards += sum(map(luhn, old))
        if not r.found:
            assert r.old == r.text
    assert cards > 5
