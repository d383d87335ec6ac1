"""Source divergence against a plain version, word by word and group by group."""

import collections
import re

import pytest

from terrane.llm.divergence import _p, divergence, term_counts

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, min_docs=3, scale=10**9, top=200):
    words, df, langs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", TERM.findall(lowered(text))
        langs[lang].add(source)
        words[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]

        def p_of(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + scale * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: p_of(words[lang, s]) for s in sources}
        q = p_of(sum((words[lang, s] for s in sources), collections.Counter()))
        f = lambda x, y: (x - y) * (x - y) // y
        for s in sources:
            values = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if words[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", values), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(ranked, 1) if part == "pair" or i <= top]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_cases(docs, rows):
    found = divergence(docs)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert got(found) == plain([(lang, source, text) for _, text, lang, source, _ in rows])


@pytest.mark.parametrize("few", [1, 2, 50])
def test_bounds(docs, rows, few):
    """Other bounds: words of one document, no kept word at all in most languages, three words a group."""
    assert got(divergence(docs, min_docs=few, top_terms=3, shares=3)) == plain([(lang, source, text) for _, text, lang, source, _ in rows], few, top=3)


def test_hand_made(spark):
    rows = [("en", "a", "One one\tTWO two"), ("en", "b", "one two"), ("en", "c", "one"), ("en", None, None), (None, "x", "1 2 3"), (None, "y", ""), ("de", "z", "Ä ä Ärger")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    found = got(divergence(df))
    assert found == plain(rows)
    assert ("", "x", "pair", "y", 0, 1) in found and not [r for r in found if r[0] == "de"]


def test_counts_need_a_decimal(spark):
    """Counts for which scale * count is more than a long."""
    df = spark.createDataFrame([(c, t) for c in (0, 90, 91, 92, 10**6, 10**12) for t in (7, 10**12, 10**13)], "c long, t long").where("c <= t")
    for r in df.select("c", "t", _p(10**9, "c", "t").alias("p"), _p(10**17, "c", "t").alias("far")).collect():
        assert r["p"] == 1 + 10**9 * (r["c"] + 1) // r["t"] and r["far"] == 1 + 10**17 * (r["c"] + 1) // r["t"]


def test_empty(spark, empty):
    assert divergence(empty).count() == 0


def test_words_are_found_once(docs):
    """The texts reach the shuffle as counts: nothing before it filters them by their words."""
    plan = term_counts(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
