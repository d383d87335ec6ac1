"""How far the sources of a language are from each other, and which words set a source apart.

Plain relational: words are exploded and counted by (language, source), the groups are joined with their language's kept
vocabulary so that words a group lacks count as zero, groups meet each other by (language, word), and what a pair differs by is
summed and ranked. All arithmetic is on integers:

* a language keeps the words of at least ``min_docs`` of its documents, V of them;
* a group, or a whole language, gives a kept word that it has ``count`` times ``p = 1 + scale * (count + 1) // (N + V)``, N being the
  sum of its counts over kept words;
* p differs from q by ``f = (p - q)**2 // q``.

Zeros are not made one by one. All words that a group lacks have the same p in it, so the group is joined with the number of them, one
row, as it is with the number of words that it has once, twice and so on; the self-join by (language, word) then covers the words that both groups
have, and corrects what their numbers said of them. Sums over numbers of words are those over words, by the integer.

Scale: texts are read once, and only counts are shuffled, one row a task and (language, source, word). Words are dealt by (language,
word), so one hot source or language is spread over all tasks. Figures of groups meet their words in ``shares`` shares, hashes of the
word, so that no group is one task. Pairs are summed on the map side before they are shuffled. Sums stay within a long up to
250 million kept words a language; beyond that Spark reports an overflow.

Defined cases: a null text, language or source is ''; a group without words gets every kept word by its zero; a language that
keeps no word has pairs of value 0; each row of the input is a document, repeated or not; of words or sources that tie the smaller
in UTF-8 ranks first; a very long text is counted whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, cut

#: What stands between words, which are made of letters of ASCII and of all that is beyond it.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, count, n_docs of every word of every group."""
    # splitting finds the same words as matching them, at a tenth of the cost; before the first and after the last may be an empty one
    words = F.sort_array(F.split(F.translate(_text(text), UPPER, LOWER), BETWEEN))
    rows = docs.select(_text(lang).alias("lang"), _text(source).alias("source"), words.alias("words"))
    # in a sorted text a word is new where it differs from the one before it
    rows = rows.select("lang", "source", "words", F.posexplode_outer("words").alias("at", "term"))
    new = (F.col("at") == 0) | (F.get("words", F.col("at") - 1) != F.col("term"))
    # outer, because Spark would filter the others by their words before it spreads them, and find all words twice
    rows = rows.select("lang", "source", "term", new.cast("long").alias("new")).where("term <> ''")
    return rows.groupBy("lang", "term", "source").agg(F.count(F.lit(1)).alias("count"), F.sum("new").alias("n_docs"))


def _p(scale: int, count: str, total: str) -> Column:
    """1 + floor(scale * (count + 1) / total), exact however many words there are."""
    small = f"(({count}) + 1L) * {scale}L div ({total})"
    large = f"cast(({count}) + 1L as decimal(19, 0)) * cast({scale}L as decimal(18, 0)) div cast({total} as decimal(19, 0))"
    return F.expr(f"1L + if({total} = 0, 0L, if({count} < {(2**63 - 1) // scale - 1}L, {small}, {large}))")


def _f(p: str, q: str) -> str:
    return f"({p} - {q}) * ({p} - {q}) div {q}"


def divergence(docs: DataFrame, min_docs: int = 3, scale: int = 10**9, top_terms: int = 200, shares: int = 64, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: how far a group is from each other source of its language, q being that source's. Part ``term``: the first
    ``top_terms`` words that a group has more of than its language, q being the language's.
    """
    space = Workspace(docs.sparkSession)
    try:
        of_word = Window.partitionBy("term", "lang")
        counted = term_counts(docs, text, lang, source).withColumns({"df": F.sum("n_docs").over(of_word), "in_lang": F.sum("count").over(of_word)})
        kept = space.write(counted.where(F.col("df") >= min_docs).select("lang", "term", "source", "count", "in_lang"), "kept")
        groups = cut(_groups(docs.select(_text(lang).alias("lang"), _text(source).alias("source")).distinct(), kept, scale))
        shared = groups.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
        hashed = kept.withColumn("hash", F.xxhash64("lang", "term")).withColumn("share", F.pmod("hash", F.lit(shares)))
        words = hashed.join(shared, ["lang", "source", "share"]).select("hash", "lang", "term", "id", "zero", _p(scale, "count", "n + v").alias("p"), _p(scale, "in_lang", "n_lang + v").alias("q"))
        return cut(_pairs(words, groups, shared, shares).unionByName(_terms(words, groups, top_terms)))
    finally:
        space.drop()


def _groups(groups: DataFrame, kept: DataFrame, scale: int) -> DataFrame:
    """lang, source, id, n, v, n_lang, has, zero: words in all, kept words of the language, its words in all, kept words that the group has, p of those it lacks."""
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("has"))
    # a word's total stands in each of its rows and counts once
    langs = kept.groupBy("lang", "term").agg(F.first("in_lang").alias("in_lang")).groupBy("lang").agg(F.sum("in_lang").alias("n_lang"), F.count(F.lit(1)).alias("v"))
    known = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "has", "n_lang", "v"])
    return known.withColumns({"id": F.monotonically_increasing_id(), "zero": _p(scale, "0L", "n + v")})


def _named(rows: DataFrame, groups: DataFrame, id: str, name: str) -> DataFrame:
    return rows.join(groups.select(F.col("id").alias(id), "lang", F.col("source").alias(name)), id).drop(id)


def _pairs(words: DataFrame, groups: DataFrame, shared: DataFrame, shares: int) -> DataFrame:
    # how many words a group gives each p, those it lacks among them, against a group that lacks them all
    numbers = words.groupBy("lang", "id", "zero", "p").agg(F.count(F.lit(1)).alias("m"))
    numbers = numbers.unionByName(groups.select("lang", "id", "zero", F.col("zero").alias("p"), (F.col("v") - F.col("has")).alias("m")))
    numbers = numbers.withColumn("share", F.pmod(F.xxhash64("p"), F.lit(shares)))
    other = shared.select("lang", "share", F.col("id").alias("other"), F.col("zero").alias("none"))
    alone = numbers.join(other, ["lang", "share"]).where("id <> other").groupBy("id", "other")
    alone = alone.agg(F.sum(F.expr(f"m * ({_f('p', 'none')})")).alias("out"), F.sum(F.expr(f"m * ({_f('none', 'p')} - {_f('none', 'zero')})")).alias("back"))
    # words that both have
    a, b = (words.select("hash", "lang", "term", F.col("id").alias(f"id_{x}"), F.col("p").alias(x), F.col("zero").alias(f"zero_{x}")) for x in "ab")
    more = lambda x, y: f"{_f(x, y)} - {_f(x, f'zero_{y}')} - {_f(f'zero_{x}', y)} + {_f(f'zero_{x}', f'zero_{y}')}"
    both = a.join(b, ["hash", "lang", "term"]).where("id_a < id_b").groupBy(F.col("id_a").alias("id"), F.col("id_b").alias("other"))
    both = both.agg(F.sum(F.expr(more("a", "b"))).alias("out"), F.sum(F.expr(more("b", "a"))).alias("back"))
    # one generator, so that the sums are not made once for each way
    ways = F.array(F.struct("id", "other", F.col("out").alias("value")), F.struct(F.col("other").alias("id"), F.col("id").alias("other"), F.col("back").alias("value")))
    sums = alone.unionByName(both).select(F.inline(ways)).groupBy("id", "other").agg(F.sum("value").alias("value"))
    named = _named(sums, groups, "id", "source").join(groups.select(F.col("id").alias("other"), F.col("source").alias("item")), "other")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(words: DataFrame, groups: DataFrame, top_terms: int) -> DataFrame:
    values = words.where("p > q").select("id", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"), F.pmod("hash", F.lit(16)).alias("part"))
    # the first of each part of a group, then the first of those: no task ranks what all tasks send of one group
    order = [F.desc("value"), F.col("item")]
    first = lambda rows, *of: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*of).orderBy(*order))).where(F.col("rank") <= top_terms)
    ranked = first(first(values, "id", "part").drop("rank"), "id").drop("part")
    return _named(ranked, groups, "id", "source").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
