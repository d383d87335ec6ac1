"""Valid values whose neighbours could be taken for a part of them."""

import pytest

from terrane.llm import pii

AT, GB, DE, UNKNOWN = "AT61 1904 3002 3457 3201", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "ZZ"


def checked(country, body):
    digits = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(digits) % 97:02d}{body}"


def spaced(iban):
    return " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))


def card(payload):
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return payload + str(-total % 10)


def grouped(digits, *sizes, gap=" "):
    parts, at = [], 0
    for n in sizes:
        parts.append(digits[at : at + n])
        at += n
    return gap.join(parts)


LONG, DINERS, VISA = card("411111111111111112"), card("3056930902590"), "4111 1111 1111 1111"
CASES = [  # text, the values in it that must go, what must stay
    (f"{AT} BIC: ABCDEFGH", [AT], [" BIC: ABCDEFGH"]),
    (f"{AT} EUR 20", [AT], [" EUR 20"]),
    (f"{AT} {DE} {GB}", [AT, DE, GB], []),
    (f"{AT.replace(' ', '')} BIC", [AT.replace(" ", "")], [" BIC"]),
    (f"{spaced(checked('ZZ', '12345678901234567890'))} BIC", [spaced(checked("ZZ", "12345678901234567890"))], [" BIC"]),
    (grouped(LONG, 4, 4, 4, 4, 3), [grouped(LONG, 4, 4, 4, 4, 3)], []),
    (grouped(LONG, 4, 4, 4, 4, 3, gap="-") + ".", [grouped(LONG, 4, 4, 4, 4, 3, gap="-")], ["."]),
    (f"{VISA} 122", [VISA], [" 122"]),
    (f"{VISA} 123-45-6789", [VISA, "123-45-6789"], []),
    (f"{VISA} 12.03.2024", [VISA, "12.03.2024"], []),
    (grouped(DINERS, 4, 6, 4), [grouped(DINERS, 4, 6, 4)], []),
]


@pytest.fixture(scope="module")
def texts(spark):
    df = spark.createDataFrame([(i, f"see {t}") for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    return {r["doc_id"]: r for r in pii.pseudonymise(df, "k").collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_neighbours(texts, case):
    text, gone, stays = CASES[case]
    got = texts[case]
    assert got["replaced"] == len(gone) and len(got["text"]) == len(text) + 4
    assert not any(value in got["text"] for value in gone)
    assert all(value in got["text"] for value in stays)
