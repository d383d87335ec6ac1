"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue that is served in proportion to its weight. Its documents stand in a
shuffled order, up to ``max_epochs`` times over; a copy's virtual finish time is the source's
words up to its end divided by the source's weight, its virtual start time that of the copy before it. The queue is
truncated at the virtual time V at which the budget is used up: a copy is taken whole if it finishes by V, not at all if it does not
start before V, and of the one that a source has in service at V, the words served by then. Every source has then received
``min(weight * V, max_epochs * size)`` words, which is the target with the excess of exhausted sources reshared by
weight, to the nearest word.

Scale: the running word count inside a source comes from :func:`~terrane.llm.common.running_total`,
which deals a source over ``16**digits`` buckets of the shuffle hash, so that a source with a third of all rows
is no single task. Sources can be many: they are ranked in ranges, and V, at which the words that all sources have received reach the
budget, is found by sums over the sources, some rounds of them; no task sees all sources.

Defined cases: a null text has 0 words; null is a source of its own, after all others; documents
without words are taken 0 words; a very long text is a large document like any other, and is cut where V falls in it; documents of one
place in the shuffled order (rows that repeat an id and text in one source) stand by size, and equal rows in any order; each of them
is a further document; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, enclosed, running_total, text_of, word_count

GROUP = ["no_source", "source_key"]


def ranked(sources: DataFrame, per_part: int = 50_000) -> DataFrame:
    """Distinct sources with ``turn``, their number from 0 by code point, null last, counted range by range."""
    parts = max(1, -(-sources.count() // per_part))
    dealt = cut(sources.repartitionByRange(parts, *GROUP).withColumn("part", F.spark_partition_id()))
    before, rows = 0, []
    for r in dealt.groupBy("part").count().orderBy("part").collect():  # one row a range
        rows.append((r["part"], before))
        before += r["count"]
    shifts = dealt.sparkSession.createDataFrame(rows, "of int, before long")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*GROUP)) - 1
    return dealt.withColumn("inside", inside).join(F.broadcast(shifts), F.col("part") == F.col("of")).withColumn("turn", F.col("before") + F.col("inside")).drop("part", "of", "before", "inside")


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """(no_source, source_key, source_size) to the same with weight, target and cut_time, the virtual time V of the cut.

    Sources take the weights in turn, by code point, null last. At time v a source has received the smaller of weight * v and
    all its copies; V is where these sum up to the budget. Sources that run dry by v leave what they have not used to the others, which moves v on; when no
    further source runs dry, v is V.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    rows = cut(ranked(sizes).withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(max_epochs)))
    budget, v = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], 0.0
    while True:
        dry = F.col("cap") / F.col("weight") <= F.lit(v)
        spent, left = rows.agg(F.coalesce(F.sum(F.when(dry, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~dry, F.col("weight"))), F.lit(0.0))).first()
        later = (budget - spent) / left if left else v
        if later <= v:
            break
        v = later
    rows = rows.withColumn("cut_time", F.lit(v)).withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * v))
    return rows.select(*GROUP, "source_size", "weight", "target", "cut_time")


def queue(docs: DataFrame, weights: Sequence[float], max_epochs: int, seed: int, digits: int, text: str, source: str, doc_id: str) -> DataFrame:
    """Every document in its source's queue, with what is taken of it; see :func:`mix_sources`."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).isNull().alias("no_source"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source_key"),
        word_count(text_of(text)).alias("size"),
        shuffle_hash(seed, F.col(doc_id), F.col(text)).alias("shuffle_hash"),
    ).withColumn("bucket", F.substring("shuffle_hash", 1, digits))
    rows = cut(rows)  # numbers only: the texts are read once
    targets = source_targets(rows.groupBy(*GROUP).agg(F.sum("size").alias("source_size")), weights, max_epochs)
    mixed = running_total(rows, GROUP, "bucket", [F.col("shuffle_hash"), F.col("doc_id"), F.col("size")], "size", "words_before", "__size", targets)
    mixed = mixed.withColumn("virtual_finish", (F.col("words_before") + F.col("size")) / F.col("weight"))

    def served(epoch: int):
        """Words of the copy of an epoch that are served by the cut."""
        start = F.col("source_size") * epoch + F.col("words_before")
        finish = (start + F.col("size")) / F.col("weight") if epoch else F.col("virtual_finish")
        in_service = F.greatest(F.lit(0), F.least(F.col("size"), F.round(F.col("weight") * F.col("cut_time")).cast("long") - start))
        return F.when(finish <= F.col("cut_time"), F.col("size")).when(start / F.col("weight") < F.col("cut_time"), in_service).otherwise(F.lit(0))

    words = [served(e).cast("long") for e in range(max_epochs)]
    whole = sum((F.when((x == F.col("size")) & (F.col("size") > 0), 1).otherwise(0) for x in words), F.lit(0))
    return mixed.withColumn("taken", sum(words, F.lit(0)).cast("long")).withColumn("full_copies", whole).withColumn("part_words", F.col("taken") - F.col("full_copies") * F.col("size"))


def shuffle_hash(seed: int, doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), text_of(text)).cast("binary"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 20, digits: int = 3, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, full_copies, part_words, virtual_finish.

    ``taken`` is ``full_copies * size + part_words``; ``virtual_finish`` is the time at which the first copy
    ends in the queue. Rows come range-sorted by it.
    """
    mixed = queue(docs, weights, max_epochs, seed, digits, text, source, doc_id)
    return mixed.select("doc_id", F.when(~F.col("no_source"), F.col("source_key")).alias("source"), "size", "source_size", "target", "taken", "full_copies", "part_words", "virtual_finish").orderBy("virtual_finish", "doc_id")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 20, digits: int = 3, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The documents of the mix, with their columns: each as often as the mix takes it, a part of over half as a whole.

    Rows find their places in the queue by id, text and source. Rows that are equal in these are dealt the copies of their places evenly.
    """
    mix = queue(docs, weights, max_epochs, seed, digits, text, source, doc_id)
    copies = F.col("full_copies") + F.when(F.col("part_words") * 2 > F.col("size"), 1).otherwise(0)
    plan = mix.groupBy("shuffle_hash", *GROUP).agg(F.sum(copies).alias("copies"), F.count(F.lit(1)).alias("places")).where("copies > 0")
    of = {"shuffle_hash": "of_hash", "no_source": "of_no_source", "source_key": "of_source_key"}
    rows, column, laid_out = enclosed(docs)
    keyed = rows.withColumns({"shuffle_hash": shuffle_hash(seed, column(doc_id), column(text)), "no_source": column(source).isNull(), "source_key": F.coalesce(column(source).cast("string"), F.lit(""))})
    taken = keyed.join(plan.withColumnsRenamed(of), [F.col(a) == F.col(b) for a, b in of.items()])
    number = F.row_number().over(Window.partitionBy(*of).orderBy(F.lit(0)))
    times = F.expr("copies div places").cast("int") + F.when(number <= F.col("copies") % F.col("places"), 1).otherwise(0)
    return laid_out(taken.withColumn("times", times).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))))
