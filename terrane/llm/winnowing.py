"""Document fingerprints by winnowing, in DataFrame operations only.

A text is a sequence of units: runs of up to 16 characters other than white space, and single characters in scripts that
don't space words. Every k consecutive units hash to a gram, by the polynomial that a rolling hash keeps up (Karp and Rabin): of
units x, y, z the hash is (x * BASE + y) * BASE + z modulo a prime. Array functions have no state to roll, so each value is taken from
its k units, which gives the same. Of every window of w consecutive grams the
smallest hash is selected, the rightmost of equals. Selected hashes are kept with their position. Any
stretch of k + w - 1 units that two texts share therefore leaves a selected gram in both, and
the positions tell where.

Everything happens inside arrays of one row: a pass hashes grams, log2(w) passes take window minima by
doubling. A gram and its position are one long, the hash of 32 bits above, the position counted down below, so that a
minimum of longs breaks ties to the right. Positions have 31 bits, more than an array can have elements.

Defined cases: null is an empty text, with an empty fingerprint; shorter texts than k units are one gram, fewer grams than w
one window; two empty fingerprints are alike (1.0); a very long text is one array of its units' hashes; rows repeated have equal
fingerprints, and those that share a doc_id follow each other by a hash of their text; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, let, text_of

UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
UNIT = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]{{1,16}}"
#: Low bits of a selected gram, which hold its position.
PLACE = 31
#: The polynomial's prime, the largest of 32 bits, and its base; a product of both fits into a long.
PRIME, BASE = 2**32 - 5, 912_680_551
#: Ids from which ranges are made, about.
SAMPLE = 131_072


def select_grams(text: Column, k: int = 3, w: int = 4) -> Column:
    """The selected grams of a text in ascending position, an array of longs; see :func:`gram_hash` and :func:`gram_place`."""
    units = F.transform(F.regexp_extract_all(F.lower(text), F.lit(UNIT), F.lit(0)), lambda u: F.shiftrightunsigned(F.xxhash64(u), 1) % PRIME)
    full = F.lit((1 << PLACE) - 1).cast("long")

    def packed(h: Column, i: Column) -> Column:
        return F.shiftleft(h, PLACE).bitwiseOR(full - i)

    def polynomial(first: Column, *more: Column) -> Column:
        for x in more:
            first = (first * BASE + x) % PRIME
        return first

    def grams(u: Column) -> Column:
        rolled = F.transform(F.slice(u, F.lit(1), F.greatest(F.size(u) - (k - 1), F.lit(0))), lambda x, i: packed(polynomial(x, *[F.get(u, i + j) for j in range(1, k)]), i))
        few = F.aggregate(u, F.lit(0).cast("long"), lambda h, x: polynomial(h, x))
        return F.when(F.size(u) >= k, rolled).when(F.size(u) > 0, F.array(packed(few, F.lit(0)))).otherwise(F.array().cast("array<long>"))

    def minima(g: Column, width: int) -> Column:
        """Minima of ``width`` values, from each place that has as many."""
        if width == 1:
            return g
        half = 1 << ((width - 1).bit_length() - 1)
        return let(minima(g, half), lambda m: F.transform(F.slice(m, F.lit(1), F.greatest(F.size(m) - (width - half), F.lit(0))), lambda x, i: F.least(x, F.get(m, i + (width - half)))))

    def selected(g: Column) -> Column:
        windows = F.when(F.size(g) >= w, minima(g, w)).when(F.size(g) > 0, F.array(F.array_min(g))).otherwise(g)
        return let(windows, lambda m: F.filter(m, lambda x, i: (i == 0) | (x != F.get(m, i - 1))))

    return let(let(units, grams), selected)


def gram_hash(selected: Column) -> Column:
    return F.shiftright(selected, PLACE)


def gram_place(selected: Column) -> Column:
    return F.lit((1 << PLACE) - 1).cast("long") - selected.bitwiseAND(F.lit((1 << PLACE) - 1).cast("long"))


def as_string(selected: Column) -> Column:
    """hash:position pairs, the hash in hex."""
    return F.array_join(F.transform(selected, lambda g: F.concat(F.lower(F.hex(gram_hash(g))), F.lit(":"), gram_place(g).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of hashes, as sets."""
    both = F.size(F.array_intersect(a, b))
    return let(F.struct(both.alias("n"), F.size(F.array_union(a, b)).alias("of")), lambda x: F.when(x["of"] == 0, 1.0).otherwise(x["n"] / x["of"]))


def fingerprints(docs: DataFrame, k: int = 3, w: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (array of selected grams), one row per document; needs no shuffle."""
    return docs.select(F.col(doc_id).alias("doc_id"), select_grams(text_of(text), k, w).alias("fingerprint"))


def with_next(docs: DataFrame, per_bucket: int = 256, most_buckets: int = 65_536, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, Window]:
    """Rows (doc_id, text, next_text, tail) with the text of the document that follows in ascending doc_id, cyclically.

    Documents are dealt over ranges of doc_id with about equal counts, bounded by quantiles of a sample of the ids, and each range gets a copy
    of the first document of the next one, marked ``tail``, so that no order over all documents is needed and each text is
    shuffled once. The sample takes ids by their hash, about ``SAMPLE`` of them however large the table. Equal ids are ordered by a hash of
    the text. Only the sample and the ranges' bounds and first ids, all of bounded number, come to the driver. Also returns the window in which
    tails stand last, for further looks at the next row.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    ids = cut(rows.select("doc_id"))
    count = ids.count()
    buckets = max(1, min(most_buckets, count // per_bucket))
    bounds: list[int] = []
    if buckets > 1:
        sample = ids.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(max(1, count // SAMPLE))) == 0)).distinct()
        known = sorted(r[0] for r in sample.collect())
        bounds = sorted({known[len(known) * i // buckets] for i in range(1, buckets)}) if known else []
    first = F.when(F.count(F.when(F.col("doc_id").isNull(), 1)) > 0, None).otherwise(F.min("doc_id"))
    heads = sorted((r["b"], r["head"]) for r in ids.groupBy(bucket_of(F.col("doc_id"), bounds).alias("b")).agg(first.alias("head")).collect())
    before = [(b, heads[i - 1][0], doc) for i, (b, doc) in enumerate(heads)]
    # at most ``most_buckets`` rows
    firsts = docs.sparkSession.createDataFrame(before, "hb int, previous int, head long")
    joined = rows.withColumn("b", bucket_of(F.col("doc_id"), bounds)).join(F.broadcast(firsts), F.col("b") == F.col("hb"))
    here = F.struct(F.col("b").alias("b"), F.lit(False).alias("tail"))
    # rows that share the first id all go along; the window takes the first of them
    places = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(here, F.struct(F.col("previous").alias("b"), F.lit(True).alias("tail")))).otherwise(F.array(here))
    dealt = joined.select("doc_id", "text", F.xxhash64("text").alias("h"), F.explode(places).alias("place")).select("doc_id", "text", "h", F.col("place.b").alias("b"), F.col("place.tail").alias("tail"))
    order = Window.partitionBy("b").orderBy("tail", F.col("doc_id").asc_nulls_first(), "h")
    return dealt.withColumn("next_text", F.lead("text").over(order)), order


def constants(values: list, kind: str) -> Column:
    """A constant array, as one literal however long it is."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are below ``value``, by bisection; 0 for null."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << s) for s in range(len(bounds).bit_length() - 1, -1, -1)])
    array = constants(bounds, "bigint")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(array, at + step - 1) < value), at + step).otherwise(at))


def edited_fingerprints(docs: DataFrame, k: int = 3, w: int = 4, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, whose second half is the beginning of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows, order = with_next(docs, text=text, doc_id=doc_id, **how)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))
    rows = rows.withColumn("edited", F.when(~F.col("tail"), edited))
    printed = rows.select(
        "b",
        "tail",
        "doc_id",
        "h",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        select_grams(F.col("text"), k, w).alias("grams"),
        F.when(F.col("edited").isNotNull(), select_grams(F.col("edited"), k, w)).alias("edited_grams"),
    )
    hashed = printed.withColumn("hashes", F.transform("grams", gram_hash)).withColumn("next_hashes", F.lead("hashes").over(order)).where(~F.col("tail"))
    return hashed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("grams")).alias("fingerprint"),
        as_string(F.col("edited_grams")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.transform("edited_grams", gram_hash)).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
