"""Pseudonyms at the edges of formats: validity, form, and one pseudonym for one value."""

import datetime
import random
import re

from terrane.llm import pii


def mapped(spark, values):
    """Each value with its pseudonym, of values that don't repeat."""
    frame = spark.createDataFrame(list(enumerate(f"x {v} y" for v in values)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(frame, "k").collect()}
    return {v: got[i][2:-2] for i, v in enumerate(values)}


def test_dates(spark):
    first, last = datetime.date(1, 1, 1).toordinal(), datetime.date(9999, 12, 31).toordinal()
    days = [*range(first, first + 4000), *range(last - 4000, last + 1), *range(730_000, 732_000), *range(first, last, 997)]
    iso = sorted({datetime.date.fromordinal(d).isoformat() for d in days})
    got = mapped(spark, iso)
    assert len(set(got.values())) == len(iso)
    assert all(datetime.date.fromisoformat(x) and len(x) == 10 for x in got.values())
    assert sum(a == b for a, b in got.items()) < 10
    assert mapped(spark, ["0000-01-01", "2001-02-29"]) == {"0000-01-01": "0000-01-01", "2001-02-29": "2001-02-29"}


def read(value, order="dmy"):
    x, y, year = map(int, re.split("[./]", value))
    return datetime.date(year, *((y, x) if order == "dmy" else (x, y)))


def test_a_date_has_one_pseudonym(spark):
    """In every writing; days from 13 on stay such, so that what is month first stays so; no two dates get one."""
    rng = random.Random(1)
    days = {datetime.date.fromordinal(rng.randrange(1, datetime.date(9999, 12, 31).toordinal())) for _ in range(1500)}
    days |= {datetime.date(y, 2, 29) for y in (4, 1600, 2000, 2024, 9996)} | {datetime.date(y, m, d) for y in (1, 99, 100, 1899, 1900, 9899, 9900, 9999) for m in range(1, 13) for d in (1, 9, 12, 13, 28)}
    forms = {
        "iso": lambda d: d.isoformat(),
        "dmy": lambda d: f"{d.day:02d}.{d.month:02d}.{d.year:04d}",
        "short": lambda d: f"{d.day}/{d.month}/{d.year:04d}",
        "half": lambda d: f"{d.day}/{d.month:02d}/{d.year:04d}",
    }
    late = {d for d in days if d.day > 12}
    american = {"mdy": lambda d: f"{d.month:02d}/{d.day:02d}/{d.year:04d}", "mdy short": lambda d: f"{d.month}/{d.day}/{d.year:04d}"}
    got = mapped(spark, sorted({f(d) for f in forms.values() for d in days} | {f(d) for f in american.values() for d in late}))
    new = {d: datetime.date.fromisoformat(got[d.isoformat()]) for d in days}
    assert len(set(new.values())) == len(days) and all((d.day > 12) == (n.day > 12) for d, n in new.items())
    assert sum(d == n for d, n in new.items()) < 5
    for d in days:
        assert got[forms["dmy"](d)] == forms["dmy"](new[d])
        assert read(got[forms["short"](d)]) == read(got[forms["half"](d)]) == new[d]
        if d.day < 10 or d.month < 10:
            assert got[forms["short"](d)] == forms["short"](new[d])
    for d in late:
        assert got[american["mdy"](d)] == american["mdy"](new[d]) and read(got[american["mdy short"](d)], "mdy") == new[d]
    bad = ["31/02/2001", "13/13/1990", "0/5/1990", "30/2/2000", "1/2/0000", "2/30/2001"]
    assert mapped(spark, bad) == {v: v for v in bad}
    four = mapped(spark, ["12/25/1990", "01/02/2020", "1/2/2020"])
    assert four["12/25/1990"] != "12/25/1990" and read(four["01/02/2020"]) == read(four["1/2/2020"])


def test_spans_of_dates(spark):
    """All dates of the first, an inner and the last span: each a permutation."""
    from pyspark.sql import functions as F

    for first, last in (("0001-01-01", "0102-12-31"), ("1880-01-01", "2110-12-31"), ("9899-01-01", "9999-12-31")):
        days = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}')) AS d").select("d", pii._moved_date(F.col("d"), "k").alias("n"))
        n, kinds, same, low, high = days.agg(F.count("*"), F.countDistinct("n"), F.sum(((F.dayofmonth("d") > 12) == (F.dayofmonth("n") > 12)).cast("int")), F.min(F.year("n")), F.max(F.year("n"))).first()
        assert n == kinds == same and low >= 1 and high <= 9999


def test_long_numbers_stay_digits(spark):
    rng = random.Random(4)
    values = ["".join(rng.choice("0123456789") for _ in range(n)) for n in (32, 40, 64, 65, 200, 5000)]
    for a, b in mapped(spark, values).items():
        assert a != b and re.fullmatch(r"\d+", b) and len(a) == len(b)


def test_phones(spark):
    """No two of 20,000 valid and invalid numbers have one pseudonym; valid ones stay valid."""
    rng = random.Random(2)
    values = {f"{rng.randrange(1000):03d}-{rng.randrange(1000):03d}-{rng.randrange(10_000):04d}" for _ in range(20_000)}
    values |= {f"{a:03d}-{b:03d}-0000" for a in range(0, 1000, 50) for b in range(0, 1000, 50)}
    got = mapped(spark, sorted(values))
    assert len(set(got.values())) == len(values)
    valid = lambda v: bool(re.match(r"[2-9]..-[2-9]", v))
    assert all(valid(a) == valid(b) and re.fullmatch(r"\d{3}-\d{3}-\d{4}", b) for a, b in got.items())
    same = mapped(spark, ["+1 (389) 555-5010", "389-555-5010", "+49 30 1234567", "+493 01234567", "+1 (826) 555-4081 190.13.7.9"])
    digits = {k: re.sub(r"\D", "", v) for k, v in same.items()}
    assert digits["+1 (389) 555-5010"] == "1" + digits["389-555-5010"]
    assert digits["+49 30 1234567"] == digits["+493 01234567"] and digits["+49 30 1234567"].startswith("49")
    phone, address = same["+1 (826) 555-4081 190.13.7.9"].rsplit(" ", 1)
    assert phone == mapped(spark, ["+1 (826) 555-4081"])["+1 (826) 555-4081"] and address == mapped(spark, ["190.13.7.9"])["190.13.7.9"]


def test_long_secrets(spark):
    rng = random.Random(3)
    secrets = ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (32, 64, 128, 1000)]
    secrets += [s.upper() for s in secrets] + ["password=" + "aB3$" * 50, "pwd: secret42", "password=" + "x" * 5000]
    got = mapped(spark, secrets)
    for a, b in got.items():
        assert a != b and len(a) == len(b)
        assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", a))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", b))) or re.fullmatch("[0-9a-f]+|[0-9A-F]+", b)
    assert mapped(spark, ["password: please"]) == {"password: please": "password: please"}
