"""Format-preserving pseudonyms for personal data by keyed Feistel permutations, in DataFrame operations only.

One pattern finds candidates; each is validated as its kind demands (Luhn, IBAN check digits, octets, calendar, numbering
plan) and, if valid, its value is permuted within the set of valid values of its format: a card number becomes a card
number of the same length and issuer digit with a right check digit, a date becomes a date. The permutation depends on the
key and the kind alone, so equal values become equal pseudonyms in every document, however they are
punctuated, and different values of a kind stay different. What is not valid stays as it is, and so does all other text; but a
number in a phone's form that no numbering plan gives is somebody's mistyped phone, and is permuted among such numbers.

The permutation of a number below a * b is an alternating Feistel network over (number / b, number % b) with modular addition,
a bijection for any a and b; its round function is SHA-256. No table of pseudonyms exists and nothing is shuffled.

Kinds: email (local part), card, iban, ipv4, ssn, phone, date (ISO, and with points or slashes, day first where that is a date, else month
first), and secrets (access key ids, hexadecimal tokens, numbers of 32 digits or more, values of ``password=``).

A date is permuted among those of about its 200 years (of those that the calendar has, in the first and last span), days up to 12 and days from 13 on
each among themselves: so what only can be month first stays so, and no two dates written alike get one pseudonym. A date has one pseudonym in
every writing; that keeps the order, the marks, and whether days and months below 10 have a zero (where neither has to tell, they have one).

The key is a literal of the plan, as any parameter is: set ``spark.sql.redaction.string.regex`` where plans are logged.

Defined cases: null text stays null with 0 replaced; an empty text is empty; rows that repeat get the same text; an empty table gives an
empty result; secrets match as a whole however long they are; quantifiers are possessive or bounded, so that very long texts and words
cost linear time; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

ROUNDS = 8
#: Dates are numbered from 1900 on, days up to 12 and days from 13 on (True) each for themselves, and permuted within spans of a size, which
#: is a times another number; the first and last spans there are (span, first number, a, b) end with the years 1 and 9999.
SPANS = {False: (28_800, 200, (-10, -273_456, 99, 144), (40, 1_152_000, 100, 144)), True: (44_096, 208, (-10, -420_139, 133, 175), (40, 1_763_840, 168, 168))}
#: Days from 13 on in a month, in the mean of 400 years.
LATE_A_MONTH = 146_097 / 4800 - 12

#: The lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int) -> str:
    groups, rest = divmod(length - 4, 4)
    return f"(?:{IBAN_LENGTHS[length].replace(' ', '|')})[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{{groups}}}" + (f"[ ]?[A-Z0-9]{{{rest}}}" if rest else "") + "(?![A-Za-z0-9_])"


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}",
    "password": r"(?i:password|passwd|pwd)(?:[=:]|:[ ](?=[^\s\"']*[0-9]))[^\s\"']{4,}+",
    "akia": r"AKIA[0-9A-Z]{16}",
    "iban": "|".join(map(_iban_of, IBAN_LENGTHS)) + r"|[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?",
    "hex": r"(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}+|(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{32,}+|[0-9]{32,}+",
    "ipv4": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.[0-9])",
    "ymd": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "dmy": r"[0-9]{1,2}(?<sep>[./])[0-9]{1,2}\k<sep>[0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"[0-9]{13,19}+|[0-9]{4}(?<gap>[ -])[0-9]{4}\k<gap>[0-9]{4}\k<gap>(?:[0-9]{4}\k<gap>[0-9]{1,3}+(?![._%+@/-]+[A-Za-z0-9])(?![A-Za-z0-9_])|[0-9]{1,7}+)|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}+",
    "phone": r"\+1[ .-]?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}",
}
#: A candidate starts where no longer word or number does, and ends likewise.
PATTERN = r"(?<![A-Za-z0-9_+@])(?<![0-9]\.)(?:" + "|".join(PATTERNS.values()) + r")(?![A-Za-z0-9_])"


def power(base: int, exponent: Column) -> Column:
    """base ** exponent as a long; exact below 2**53."""
    return F.pow(F.lit(float(base)), exponent.cast("double")).cast("long")


def div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def feistel(value: Column, a: Column | int, b: Column | int, tweak: str, key: str) -> Column:
    """A keyed permutation of the numbers below a * b; ``tweak`` separates kinds."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def f(i: Column, x: Column, modulus: Column) -> Column:
        text = F.concat(F.lit(f"{key}|{tweak}|"), i.cast("string"), F.lit("|"), x.cast("string"))
        return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long") % modulus

    return let(
        F.struct(value.cast("long").alias("v"), a.alias("a"), b.alias("b")),
        lambda p: F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)),
            F.struct(div(p["v"], p["b"]).alias("l"), (p["v"] % p["b"]).alias("r")),
            lambda s, i: F.struct(
                F.when(i % 2 == 1, (s["l"] + f(i, s["r"], p["a"])) % p["a"]).otherwise(s["l"]).alias("l"),
                F.when(i % 2 == 1, s["r"]).otherwise((s["r"] + f(i, s["l"], p["b"])) % p["b"]).alias("r"),
            ),
            lambda s: s["l"] * p["b"] + s["r"],
        ),
    )


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def only(s: Column, allowed: str) -> Column:
    """The characters of ``s`` that are in the class ``allowed``."""
    return F.regexp_replace(s, f"[^{allowed}]", "")


def put_back(s: Column, allowed: str, new: Column) -> Column:
    """``s`` with its characters of the class ``allowed`` replaced, in order, by those of ``new``."""
    place = lambda i: F.length(only(s.substr(F.lit(1), i + 1), allowed))
    return F.array_join(F.transform(characters(s), lambda c, i: F.when(c.rlike(f"[{allowed}]"), new.substr(place(i), F.lit(1))).otherwise(c)), "")


def padded(number: Column, digits: Column) -> Column:
    return F.lpad(number.cast("string"), digits, F.lit("0"))


def permuted_digits(digits: Column, tweak: str, key: str) -> Column:
    """A string of up to 18 digits, permuted among those of its length."""
    n = F.length(digits)
    value = feistel(digits.cast("long"), power(10, div(n, 2)), power(10, n - div(n, 2)), tweak, key)
    return F.when(n == 0, digits).otherwise(padded(value, n))


def permuted_letters(letters: Column, first: str, tweak: str, key: str) -> Column:
    """Up to 12 letters of one case, ``first`` its a, permuted among the words of their length."""
    n = F.length(letters)
    value = F.aggregate(characters(letters), F.lit(0).cast("long"), lambda v, c: v * 26 + (F.ascii(c) - ord(first)))
    new = feistel(value, power(26, div(n, 2)), power(26, n - div(n, 2)), tweak, key)
    back = let(F.struct(new.alias("v"), n.alias("n")), lambda p: F.array_join(F.transform(F.sequence(F.lit(1), p["n"]), lambda k: F.char(div(p["v"], power(26, p["n"] - k)) % 26 + ord(first))), ""))
    return F.when(n == 0, letters).otherwise(back)


def permuted_word(s: Column, tweak: str, key: str) -> Column:
    """Letters and digits of ``s``, each in its class, permuted in blocks of 12 characters."""

    def block(w: Column) -> Column:
        w = put_back(w, "a-z", permuted_letters(only(w, "a-z"), "a", f"{tweak}a", key))
        w = let(w, lambda x: put_back(x, "A-Z", permuted_letters(only(x, "A-Z"), "A", f"{tweak}A", key)))
        return let(w, lambda x: put_back(x, "0-9", permuted_digits(only(x, "0-9"), f"{tweak}0", key)))

    starts = F.sequence(F.lit(0), div(F.length(s).cast("long") - 1, 12))
    return F.when(F.length(s) == 0, s).otherwise(F.array_join(F.transform(starts, lambda k: let(s.substr((k * 12 + 1).cast("int"), F.lit(12)), block)), ""))


def _number(s: Column, start: int, size: int) -> Column:
    return F.substring(s, start, size).cast("long")


def _card(s: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        n = F.length(d)
        payload = F.concat(F.substring(d, 1, 1), permuted_digits(d.substr(F.lit(2), n - 2), "card", key))
        return let(payload, lambda p: F.concat(p, F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: F.call_function("luhn_check", F.concat(p, c.cast("string"))))[0].cast("string")))

    def whole(s: Column, otherwise: Column) -> Column:
        return let(only(s, "0-9"), lambda d: F.when(F.call_function("luhn_check", d) & d.rlike("[1-9]"), put_back(s, "0-9", new(d))).otherwise(otherwise))

    # four groups of four and a number of its own behind them
    four = F.concat(whole(s.substr(F.lit(1), F.lit(19)), s.substr(F.lit(1), F.lit(19))), s.substr(F.lit(20), F.length(s)))
    return whole(s, F.when(s.rlike("^(?:[0-9]{4}[ -]){4}"), four).otherwise(s))


def _phone(s: Column, key: str) -> Column:
    def ten_digits(t: Column) -> Column:
        """Area and exchange from 200 to 999; or an area below 200; or only the exchange: each among its own."""
        plan = feistel((_number(t, 1, 3) - 200) * 8_000_000 + (_number(t, 4, 3) - 200) * 10_000 + _number(t, 7, 4), 800, 8_000_000, "phone", key)
        area = feistel(t.cast("long"), 20_000, 100_000, "phone0", key)
        exchange = feistel((_number(t, 1, 3) - 200) * 2_000_000 + _number(t, 4, 7), 1600, 1_000_000, "phone1", key)
        return (
            F.when(t.rlike("^[01]"), padded(area, F.lit(10)))
            .when(t.rlike("^[0-9]{3}[01]"), let(exchange, lambda v: F.concat((div(v, 2_000_000) + 200).cast("string"), padded(v % 2_000_000, F.lit(7)))))
            .otherwise(let(plan, lambda v: F.concat((div(v, 8_000_000) + 200).cast("string"), (div(v, 10_000) % 800 + 200).cast("string"), padded(v % 10_000, F.lit(4)))))
        )

    def new(d: Column) -> Column:
        n = F.length(d)
        home = (n == 10) & ~s.startswith("+") | (n == 11) & s.startswith("+1")
        # by the digits alone, so that punctuation can't tell two writings of a number apart
        country = F.when(d.rlike("^[17]"), 1).otherwise(2)
        abroad = F.concat(d.substr(F.lit(1), country), permuted_digits(d.substr(country + 1, n - country), "phone+", key))
        return F.when(home, F.concat(d.substr(F.lit(1), n - 10), let(d.substr(n - 9, F.lit(10)), ten_digits))).otherwise(abroad)

    return let(only(s, "0-9"), lambda d: F.when(F.length(d) <= 18, put_back(s, "0-9", new(d))).otherwise(s))


def _ipv4(s: Column, key: str) -> Column:
    octets = F.transform(F.split(s, r"\."), lambda x: x.cast("long"))
    return let(
        octets,
        lambda o: F.when(
            F.forall(o, lambda x: x < 256),
            let(feistel(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 65536, 65536, "ipv4", key), lambda v: F.concat_ws(".", *[(div(v, 256**k) % 256).cast("string") for k in (3, 2, 1, 0)])),
        ).otherwise(s),
    )


def _ssn(s: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        area = _number(d, 1, 3)
        value = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + _number(d, 4, 2) - 1) * 9999 + _number(d, 6, 4) - 1
        return let(
            feistel(value, 898, 99 * 9999, "ssn", key),
            lambda v: let(div(v, 99 * 9999) + 1, lambda x: F.concat(padded(x + F.when(x >= 666, 1).otherwise(0), F.lit(3)), F.lit("-"), padded(div(v, 9999) % 99 + 1, F.lit(2)), F.lit("-"), padded(v % 9999 + 1, F.lit(4)))),
        )

    return F.when(s.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), let(only(s, "0-9"), new)).otherwise(s)


def _moved_date(day: Column, key: str) -> Column:
    """The pseudonym of a date, as a date."""
    epoch = F.lit("1900-01-01").cast("date")
    months = lambda d: ((F.year(d) - 1900) * 12 + F.month(d) - 1).cast("long")
    # how many days from 13 on are between the epoch and a month's first
    before = lambda m: F.datediff(F.add_months(epoch, m.cast("int")), epoch).cast("long") - m * 12

    def early(i: Column) -> Column:
        return F.date_add(F.add_months(epoch, div(i - F.pmod(i, F.lit(12)), 12).cast("int")), F.pmod(i, F.lit(12)).cast("int"))

    def late(i: Column) -> Column:
        about = F.floor(i / LATE_A_MONTH)
        month = let(about, lambda m: F.filter(F.array(m + 1, m, m - 1), lambda x: before(x) <= i)[0])
        return let(month, lambda m: F.date_add(F.add_months(epoch, m.cast("int")), (i - before(m) + 12).cast("int")))

    def new(p: Column) -> Column:
        span = F.floor(p["i"] / p["size"])
        first, last = span == p["first"]["span"], span == p["last"]["span"]
        within = F.when(first, p["first"]).when(last, p["last"]).otherwise(F.struct(span.alias("span"), (span * p["size"]).alias("at"), p["a"].alias("a"), div(p["size"], p["a"]).alias("b")))
        return let(within, lambda w: w["at"] + feistel(p["i"] - w["at"], w["a"], w["b"], "date", key))

    def numbered(i: Column, late: bool) -> Column:
        size, a, *ends = SPANS[late]
        number = lambda x: F.lit(x).cast("long")
        end = lambda e: F.struct(*[number(x).alias(n) for n, x in zip(("span", "at", "a", "b"), e, strict=True)])
        return F.struct(i.alias("i"), number(size).alias("size"), number(a).alias("a"), end(ends[0]).alias("first"), end(ends[1]).alias("last"))

    is_late = F.dayofmonth(day) > 12
    since = F.datediff(day, epoch).cast("long")
    place = F.when(is_late, numbered(since - (months(day) + 1) * 12, True)).otherwise(numbered(months(day) * 12 + F.dayofmonth(day) - 1, False))
    moved = let(place, new)
    return let(F.struct(moved.alias("i"), is_late.alias("late")), lambda m: F.when(m["late"], late(m["i"])).otherwise(early(m["i"])))


def _date(day: Column, s: Column, key: str, form: Callable[[Column], Column]) -> Column:
    """``day``: the date, null if there is no such day."""
    return let(day, lambda d: F.when(F.year(d).between(1, 9999), let(_moved_date(d, key), form)).otherwise(s))


def _ymd(s: Column, key: str) -> Column:
    return _date(s.try_cast("date"), s, key, lambda d: F.date_format(d, "yyyy-MM-dd"))


def _dmy(s: Column, key: str) -> Column:
    """Day first where that is a date, else month first."""

    def new(p: Column) -> Column:
        of = lambda day, month: F.concat_ws("-", p["year"], F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")
        day_first = of(p["x"], p["y"])
        # a part of two digits that doesn't start with a zero is written as the other
        short = lambda x, y: (F.length(x) == 1) | (~x.startswith("0") & (F.length(y) == 1))
        written = lambda part, x, y: F.when(short(x, y), part.cast("string")).otherwise(F.lpad(part.cast("string"), 2, "0"))

        def form(d: Column) -> Column:
            x, y = F.when(day_first.isNotNull(), F.dayofmonth(d)).otherwise(F.month(d)), F.when(day_first.isNotNull(), F.month(d)).otherwise(F.dayofmonth(d))
            return F.concat(written(x, p["x"], p["y"]), p["mark"], written(y, p["y"], p["x"]), p["mark"], F.date_format(d, "yyyy"))

        return _date(F.coalesce(day_first, of(p["y"], p["x"])), s, key, form)

    parts = F.split(s, "[./]")
    return let(F.struct(parts[0].alias("x"), parts[1].alias("y"), parts[2].alias("year"), F.regexp_extract(s, "[./]", 0).alias("mark")), new)


def _iban(s: Column, key: str) -> Column:
    def rest97(text: Column) -> Column:
        """The value modulo 97 of digits and letters, A as 10."""
        return F.aggregate(characters(text), F.lit(0).cast("long"), lambda v, c: F.when(c.rlike("[0-9]"), (v * 10 + F.ascii(c) - 48) % 97).otherwise((v * 100 + F.ascii(c) - 55) % 97))

    def new(t: Column) -> Column:
        body = permuted_word(t.substr(F.lit(5), F.length(t) - 4), "iban", key)
        return let(body, lambda b: F.concat(F.substring(t, 1, 2), padded(98 - rest97(F.concat(b, F.substring(t, 1, 2), F.lit("00"))), F.lit(2)), b))

    def valid(t: Column) -> Column:
        return rest97(F.concat(t.substr(F.lit(5), F.length(t) - 4), F.substring(t, 1, 4))) == 1

    # a country of unknown length: up to which space the check digits are right, the longest first
    ends = F.filter(F.sequence(F.length(s), F.lit(15), F.lit(-1)), lambda i: (i == F.length(s)) | (s.substr(i + 1, F.lit(1)) == " "))
    longest = F.filter(ends, lambda i: let(only(s.substr(F.lit(1), i), "A-Z0-9"), lambda t: (F.length(t) >= 12) & valid(t)))
    return F.when(F.length(s) < 15, let(only(s, "A-Z0-9"), lambda t: F.when(valid(t), put_back(s, "A-Z0-9", new(t))).otherwise(s))).otherwise(
        let(F.get(longest, 0), lambda i: F.when(i.isNull(), s).otherwise(F.concat(let(s.substr(F.lit(1), i), lambda p: put_back(p, "A-Z0-9", new(only(p, "A-Z0-9")))), s.substr(i + 1, F.length(s)))))
    )


def _hex(s: Column, key: str) -> Column:
    def block(w: Column) -> Column:
        n = F.length(w)
        value = feistel(F.conv(w, 16, 10).cast("long"), power(16, div(n, 2)), power(16, n - div(n, 2)), "hex", key)
        return F.lpad(F.lower(F.hex(value)), n, F.lit("0"))

    starts = F.sequence(F.lit(0), div(F.length(s).cast("long") - 1, 12))
    new = F.array_join(F.transform(starts, lambda k: let(s.substr((k * 12 + 1).cast("int"), F.lit(12)), block)), "")
    return F.when(s.rlike("[A-F]"), F.upper(new)).otherwise(new)


def _after(s: Column, head: str, tweak: str, key: str) -> Column:
    """What follows ``head`` in ``s``, permuted as a word."""
    start = F.length(F.regexp_extract(s, head, 0))
    return F.concat(s.substr(F.lit(1), start), permuted_word(s.substr(start + 1, F.length(s) - start), tweak, key))


def pseudonym(s: Column, key: str) -> Column:
    """The pseudonym of one candidate; the candidate itself if it isn't valid."""
    whole = lambda name: s.rlike(f"^(?:{PATTERNS[name]})$")
    at = F.instr(s, "@")
    return (
        F.when(whole("email"), F.concat(permuted_word(s.substr(F.lit(1), at - 1), "email", key), s.substr(at, F.length(s))))
        .when(whole("password"), _after(s, "^[A-Za-z]+[=:][ ]?", "password", key))
        .when(whole("akia"), _after(s, "^AKIA", "akia", key))
        .when(s.rlike("^[0-9]{32,}$"), permuted_word(s, "digits", key))
        .when(whole("hex"), _hex(s, key))
        .when(whole("ipv4"), _ipv4(s, key))
        .when(whole("ymd"), _ymd(s, key))
        .when(whole("dmy"), _dmy(s, key))
        .when(whole("ssn"), _ssn(s, key))
        .when(whole("card"), _card(s, key))
        .when(whole("phone"), _phone(s, key))
        .when(whole("iban"), _iban(s, key))
        .otherwise(s)
    )


@functools.lru_cache(maxsize=16)
def _pseudonyms(application: str, key: str) -> Column:
    """The pseudonyms of the candidates in __hits; an expression of some thousand parts, made once per application."""
    return F.transform("__hits", lambda s: pseudonym(s, key))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, replaced (how many values were), text with pseudonyms in place."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text"))
    # only texts with one of these can hold a candidate
    rows = rows.withColumn("__hits", F.when(F.col("__text").rlike("[0-9@]|AKIA|(?i:password|passwd|pwd)"), F.regexp_extract_all("__text", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("__new", _pseudonyms(docs.sparkSession.sparkContext.applicationId, key))
    rows = rows.withColumn("replaced", F.aggregate(F.zip_with("__hits", "__new", lambda a, b: (a != b).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x))
    gaps = F.split("__text", PATTERN, -1)
    joined = F.array_join(F.zip_with(gaps, "__new", lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    return rows.select("doc_id", F.coalesce("replaced", F.lit(0)).cast("long").alias("replaced"), F.when(F.size("__hits") > 0, joined).otherwise(F.col("__text")).alias("text"))
