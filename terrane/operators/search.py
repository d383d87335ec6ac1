"""Full-text search: an inverted index over any (id, text) table, and searches on it or on the bare text.

Two ways to the same results:

* :class:`Index` is built once and stored. One row per (term, document) holds the term's frequency, its positions and the
  document's length, so that ranking joins nothing but the few dictionary rows of the query's terms. A field of a corpus has a
  folder, partitioned by a hash of the term: a search reads only the parts that its terms hash to.
* ``scan_*`` functions search text that has no index in one pass, with a count per query term and document and no shuffle
  but that of the answer.

Ranks end in the document id, so that ties have one order.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from datetime import UTC, datetime
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions.text import identifier_tokens, term_frequency, tokens

from .barriers import computed, cut, let

K1, B = 1.2, 0.75


# the index


def postings(docs: DataFrame, id: str, text: str, corpus: str = "default", field: str | None = None, tokenizer=tokens) -> DataFrame:
    """corpus, field, doc_id, term, pos (from 0): one row per token."""
    # the outer form, because for the other one the optimizer tokenizes a second time, to see if there is a token
    rows = docs.select(F.col(id).alias("doc_id"), F.posexplode_outer(tokenizer(F.col(text))).alias("pos", "term")).where("term is not null")
    return rows.select(F.lit(corpus).alias("corpus"), F.lit(field or text).alias("field"), "doc_id", "term", "pos")


def term_rows(docs: DataFrame, id: str, text: str, corpus: str = "default", field: str | None = None, buckets: int = 256, tokenizer=tokens, empty: bool = False) -> DataFrame:
    """corpus, field, bucket, term, doc_id, tf, dl, positions: one row per term and document.

    A document's tokens are sorted with their places inside its row and cut where the term changes: nothing is shuffled.
    ``empty``: a document without a token has one row too, without a term.
    """

    places = F.sort_array(F.transform(tokenizer(F.col(text)), lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    new = lambda terms: F.filter(F.sequence(F.lit(0), F.size(terms) - 1), lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))
    # only where a term begins is found by a lambda; the rest is done behind the generator, once a row of the result
    sorted_ = docs.select(F.col(id).alias("doc_id"), places.alias("p")).select("doc_id", F.col("p.term").alias("terms"), F.col("p.pos").alias("places"), F.when(F.size("p") > 0, let(F.col("p.term"), new)).alias("starts"))
    rows = sorted_.select("doc_id", "terms", "places", "starts", F.posexplode_outer("starts").alias("j", "at"))
    n = F.coalesce(F.get("starts", F.col("j") + 1), F.size("terms")) - F.col("at")
    made = {"tf": n, "dl": F.size("terms"), "positions": F.slice("places", F.col("at") + 1, n)}
    if empty:
        none = {"tf": F.lit(0), "dl": F.lit(0), "positions": F.array().cast("array<int>")}
        made = {c: F.when(F.col("at").isNull(), none[c]).otherwise(x) for c, x in made.items()}
    else:
        rows = rows.where("at is not null")
    rows = rows.select("doc_id", F.get("terms", F.col("at")).alias("term"), *[x.alias(c) for c, x in made.items()])
    return rows.select(F.lit(corpus).alias("corpus"), F.lit(field or text).alias("field"), bucket_of(F.col("term"), buckets).alias("bucket"), "term", "doc_id", "tf", "dl", "positions")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def term_stats(docs: DataFrame, id: str, text: str, corpus: str = "default", field: str | None = None, buckets: int = 256, tokenizer=tokens) -> DataFrame:
    """corpus, field, bucket, term, df, cf: the dictionary of a table's terms, counted without rows by term and document.

    In a sorted text a term is new where it differs from the one before.
    """
    # the outer form, because for the other one the optimizer tokenizes a second time, to see if there is a token
    rows = docs.select(F.sort_array(tokenizer(F.col(text))).alias("words")).select("words", F.posexplode_outer("words").alias("at", "term"))
    new = (F.col("at") == 0) | (F.get("words", F.col("at") - 1) != F.col("term"))
    counts = rows.select("term", new.cast("long").alias("new")).where("term is not null").groupBy("term").agg(F.sum("new").alias("df"), F.count(F.lit(1)).alias("cf"))
    return counts.select(F.lit(corpus).alias("corpus"), F.lit(field or text).alias("field"), bucket_of(F.col("term"), buckets).alias("bucket"), "term", "df", "cf")


def dictionary(rows: DataFrame) -> DataFrame:
    """corpus, field, bucket, term, df, cf of :func:`term_rows`."""
    return rows.groupBy("corpus", "field", "bucket", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(docs: DataFrame, id: str, text: str, corpus: str = "default", field: str | None = None, tokenizer=tokens) -> DataFrame:
    """corpus, field, n_docs, n_tokens, avg_dl. Documents without text, or without a token, count as documents."""
    dl = F.coalesce(F.size(tokenizer(F.col(text))), F.lit(0))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.greatest(dl, F.lit(0))).alias("n_tokens")).select(F.lit(corpus).alias("corpus"), F.lit(field or text).alias("field"), "n_docs", "n_tokens", (F.col("n_tokens") / F.col("n_docs")).alias("avg_dl"))


def bm25(tf: Column, df: Column, dl: Column, n_docs: Column, avg_dl: Column, k1: float = K1, b: float = B) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_dl))


def tf_idf(tf: Column, df: Column, dl: Column, n_docs: Column, avg_dl: Column) -> Column:
    return (F.lit(1.0) + F.log(tf.cast("double"))) * F.log(n_docs / df)


SCORES = {"bm25": bm25, "tfidf": tf_idf}


#: Columns of the stored tables; ``id_type`` is the type of the documents' ids.
TERM_ROWS = "term string, doc_id {id_type}, tf int, dl int, positions array<int>, bucket int"
DOCS = "doc_id {id_type}, dl long"
DICTIONARY = "term string, df long, cf long, bucket int"
FIGURES = "corpus string, field string, part string, id_type string, n_docs long, n_tokens long, avg_dl double, stored_at timestamp, segments array<string>"
LOOKUPS = "key string, term string, df long, cf long, home int, bucket int"
#: Segments on top of a field's first part before they are put into one.
TIER = 8


SEGMENT = ("term", "doc_id", "tf", "dl", "positions", "bucket")


def _named(rows: DataFrame, corpus: str, field: str) -> DataFrame:
    return rows.select(F.lit(corpus).alias("corpus"), F.lit(field).alias("field"), "*")


class Index:
    """A stored index; :meth:`add` writes a corpus, the searches read it. One writer at a time.

    A field of a corpus is a first part and the segments that :meth:`update` and :meth:`delete` put on top of it, none of which is ever
    rewritten. A segment lists the documents that it replaces or deletes; what older parts hold of them is passed over by every search. After
    ``TIER`` segments the next one takes them all in; :meth:`merge` makes one part of everything.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def add(self, docs: DataFrame, id: str, text_cols: Sequence[str], corpus: str, tokenizer=tokens, replace: bool = False) -> None:
        """Indexes text columns of a table as the fields of a corpus; a field of a corpus that is there already is refused, or replaced.

        ``tokenizer``: a function from a column to its tokens, such as ``bigrams`` for scripts that don't space words.
        """
        for field in text_cols:
            if not replace and self.knows(corpus, field):
                raise ValueError(f"{corpus}.{field} is in the index already")
            self.store(term_rows(docs, id, field, corpus, field, self.buckets, tokenizer), corpus, field, docs.select(F.col(id).alias("doc_id")))

    def update(self, docs: DataFrame, id: str, field: str, corpus: str, tokenizer=tokens) -> None:
        """Puts documents of a table in the place of those of the same id, and adds those that are new, as a segment.

        Of several rows of one id the one of greatest text counts.
        """
        self.figures(corpus, field)  # known, or an error
        latest = cut(docs.groupBy(F.col(id).alias("doc_id")).agg(F.max(field).alias(field)))
        self._segment(term_rows(latest, "doc_id", field, corpus, field, self.buckets, tokenizer), latest.select("doc_id"), corpus, field, gone=False)

    def delete(self, ids: DataFrame, corpus: str, field: str) -> None:
        """Deletes the documents of a table of ids (its first column), as a segment that holds nothing else."""
        ids = cut(ids.select(F.col(f"`{ids.columns[0]}`").alias("doc_id")).distinct())
        none = self.rows(corpus, field).limit(0)
        self._segment(none, ids, corpus, field, gone=True)

    def merge(self, corpus: str, field: str) -> None:
        """Makes one part of a field's parts, of what they hold now."""
        self.store(self.rows(corpus, field), corpus, field, self._docs(corpus, field).select("doc_id"))

    def _segment(self, rows: DataFrame, ids: DataFrame, corpus: str, field: str, gone: bool) -> None:
        before = self.figures(corpus, field)
        part, segments = uuid.uuid4().hex, list(before["segments"] or [])
        replaced = self._docs(corpus, field).join(ids, "doc_id", "left_semi").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if len(segments) >= TIER:
            # older segments go into this one: what they hold and is not replaced again, and all documents that they replace
            older = [self._part(p, corpus, field, before) for p in segments]
            held, listed = self._live(older)
            rows = rows.select(*SEGMENT).unionByName(held.join(ids, "doc_id", "left_anti").select(*SEGMENT))
            listed = listed.join(ids, "doc_id", "left_anti")
        else:
            listed = None
        self._write(rows.select(*SEGMENT), part)
        own = self.spark.read.schema(TERM_ROWS.format(id_type=before["id_type"])).parquet(f"{self.path}/terms/{part}")
        docs = ids.join(own.groupBy("doc_id").agg(F.max("dl").cast("long").alias("length")), "doc_id", "left").select("doc_id", F.lit(None).cast("long").alias("dl") if gone else F.coalesce("length", F.lit(0).cast("long")).alias("dl"))
        self._write_docs(docs if listed is None else docs.unionByName(listed), part)
        new = self._read_docs(part, before["id_type"]).join(ids, "doc_id", "left_semi").where("dl is not null").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        n_docs, n_tokens = before["n_docs"] - replaced[0] + new[0], before["n_tokens"] - replaced[1] + new[1]
        self._state(corpus, field, before["part"], before["id_type"], n_docs, n_tokens, [part] if listed is not None else [*segments, part])

    def _write(self, rows: DataFrame, part: str) -> None:
        # dealt by bucket into files of one size: what is too much for one task, as a hot term's bucket, adaptive execution splits
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc_id").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/terms/{part}")

    def _write_docs(self, docs: DataFrame, part: str) -> None:
        docs.select("doc_id", "dl").write.parquet(f"{self.path}/docs/{part}")

    def _read_docs(self, part: str, id_type: str) -> DataFrame:
        return self.spark.read.schema(DOCS.format(id_type=id_type)).parquet(f"{self.path}/docs/{part}")

    def _state(self, corpus: str, field: str, part: str, id_type: str, n_docs: int, n_tokens: int, segments: list[str]) -> None:
        figures = [(corpus, field, part, id_type, n_docs, n_tokens, n_tokens / n_docs if n_docs else 0.0, datetime.now(UTC), segments)]
        self.spark.createDataFrame(figures, FIGURES).coalesce(1).write.mode("append").parquet(f"{self.path}/stats")

    def _part(self, part: str, corpus: str, field: str, figures: Row) -> tuple[DataFrame, DataFrame]:
        """Term rows and documents of a part, as they were written."""
        rows = self.spark.read.schema(TERM_ROWS.format(id_type=figures["id_type"])).parquet(f"{self.path}/terms/{part}")
        return rows, self._read_docs(part, figures["id_type"])

    @staticmethod
    def _live(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
        """What parts, the oldest first, hold together: each without the documents that a later one lists."""
        rows, docs = parts[0]
        for later_rows, later_docs in parts[1:]:
            ids = later_docs.select("doc_id")
            rows = rows.join(ids, "doc_id", "left_anti").unionByName(later_rows)
            docs = docs.join(ids, "doc_id", "left_anti").unionByName(later_docs)
        return rows, docs

    def _docs(self, corpus: str, field: str) -> DataFrame:
        """doc_id, dl of the documents that a field holds."""
        f = self.figures(corpus, field)
        return self._live([self._part(p, corpus, field, f) for p in (f["part"], *(f["segments"] or []))])[1].where("dl is not null")

    def store(self, rows: DataFrame | Sequence[DataFrame], corpus: str, field: str, ids: DataFrame) -> None:
        """Puts :func:`term_rows` of documents (doc_id) in the place of what the field of the corpus has held.

        Rows in several tables are dealt and written one table after the other. Lengths of documents (dl) come from ``ids`` if it has
        them, else from the rows.

        They get folders of their own, and the row of figures that names these is written last: until then, or if that fails, searches
        find the earlier state. :meth:`vacuum` deletes what is not named any more.
        """
        part = uuid.uuid4().hex
        terms, known = f"{self.path}/terms/{part}", f"{self.path}/dictionary/{part}"
        tables = [rows] if isinstance(rows, DataFrame) else rows
        for table in tables:
            self._write(table.select(*SEGMENT), part)
        id_type = tables[0].schema["doc_id"].dataType.simpleString()
        written = self.spark.read.schema(TERM_ROWS.format(id_type=id_type)).parquet(terms)
        dictionary(_named(written, corpus, field)).drop("corpus", "field").hint("rebalance", "bucket").write.partitionBy("bucket").parquet(known)
        if "dl" not in ids.columns:
            lengths = written.groupBy("doc_id").agg(F.max("dl").cast("long").alias("dl")).withColumnRenamed("doc_id", "of")
            ids = ids.join(lengths, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", F.coalesce("dl", F.lit(0).cast("long")).alias("dl"))
        self._write_docs(ids, part)
        # rows that repeat an id count as often as they come, their tokens too
        n_docs, n_tokens = self._read_docs(part, id_type).count(), written.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
        self._state(corpus, field, part, id_type, n_docs, n_tokens, [])

    def index_terms(self, corpus: str, field: str) -> None:
        """Stores keys by which :meth:`terms_like` and :meth:`terms_near` find terms of a field without reading its dictionary.

        They are of what one part holds: where segments are on top of it, the dictionary is searched until :meth:`merge` and another call.
        """
        figures = self.figures(corpus, field)
        if figures["segments"]:
            raise ValueError(f"{corpus}.{field} has segments: merge it first")
        keys = lookups(self._read("dictionary", DICTIONARY, corpus, field), self.buckets)
        keys.hint("rebalance", "bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/lookups/{figures['part']}")

    def _looked_up(self, corpus: str, field: str, keys: Sequence[str], every: bool) -> DataFrame | None:
        """Dictionary rows of the terms with all or any of some keys; None where keys are not stored for what the field holds."""
        figures = self.figures(corpus, field)
        # written last, so that keys without it are known to be unfinished
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/lookups/{figures['part']}/_SUCCESS")
        if not keys or figures["segments"] or not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            return None
        rows = self.spark.read.schema(LOOKUPS).parquet(f"{self.path}/lookups/{figures['part']}").where(self._buckets(keys) & F.col("key").isin(*keys))
        # a term has a key once
        found = rows.groupBy("term", "df", "cf", "home").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(keys) if every else F.lit(True))
        return _named(found.select(F.col("home").alias("bucket"), "term", "df", "cf"), corpus, field)

    def knows(self, corpus: str, field: str) -> bool:
        return not self._figures().where((F.col("corpus") == corpus) & (F.col("field") == field)).isEmpty()

    def _figures(self) -> DataFrame:
        """A row for each field of a corpus, as stored last."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/stats")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        rows = self.spark.read.schema(FIGURES).parquet(f"{self.path}/stats") if there else self.spark.createDataFrame([], FIGURES)
        last = F.row_number().over(Window.partitionBy("corpus", "field").orderBy(F.desc("stored_at")))
        return rows.withColumn("last", last).where("last = 1").drop("last")

    def figures(self, corpus: str, field: str) -> Row:
        found = self._figures().where((F.col("corpus") == corpus) & (F.col("field") == field)).first()
        if found is None:
            raise KeyError(f"{corpus}.{field} is not in the index")
        return found

    def vacuum(self) -> None:
        """Deletes what replaced or failed additions have left. No addition or search may run meanwhile."""
        live = {p for r in self._figures().select("part", "segments").collect() for p in (r["part"], *(r["segments"] or []))}
        for table in ("terms", "dictionary", "docs", "lookups"):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
            files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in files.listStatus(path) if files.exists(path) else []:
                if status.getPath().getName() not in live:
                    files.delete(status.getPath(), True)

    def _read(self, table: str, columns: str, corpus: str, field: str) -> DataFrame:
        figures = self.figures(corpus, field)
        return _named(self.spark.read.schema(columns.format(**figures.asDict())).parquet(f"{self.path}/{table}/{figures['part']}"), corpus, field)

    def rows(self, corpus: str, field: str, terms: Sequence[str] | None = None) -> DataFrame:
        """Rows of some terms, or of all; only the folders of the terms' buckets are read."""
        figures = self.figures(corpus, field)
        asked = (lambda rows: rows) if terms is None else (lambda rows, b=self._buckets(terms): rows.where(b & F.col("term").isin(*terms)))
        parts = [self._part(p, corpus, field, figures) for p in (figures["part"], *(figures["segments"] or []))]
        return _named(self._live([(asked(rows), docs) for rows, docs in parts])[0], corpus, field)

    def _buckets(self, terms: Sequence[str]) -> Column:
        numbers = self.spark.range(1).select(*[bucket_of(F.lit(t), self.buckets) for t in terms]).first()
        return F.col("bucket").isin(*sorted(set(numbers)))

    def dictionary(self, corpus: str, field: str) -> DataFrame:
        """term, df, cf, bucket of what a field holds; counted anew where segments have changed it."""
        if self.figures(corpus, field)["segments"]:
            return dictionary(self.rows(corpus, field))
        return self._read("dictionary", DICTIONARY, corpus, field)

    def search(self, corpus: str, field: str, any: Sequence[str] = (), all: Sequence[str] = (), none: Sequence[str] = (), k: int | None = 10, score: str = "bm25", where: DataFrame | None = None) -> DataFrame:
        """The ``k`` best documents, or all if None, with a term of ``any`` and each of ``all`` but none of ``none``: doc_id, score.

        ``where``: a table with a doc_id; only those documents count as hits. Document frequencies stay those of the corpus.
        """
        any, all, none = (list(dict.fromkeys(x)) for x in (any, all, none))
        wanted = list(dict.fromkeys([*any, *all]))
        if not wanted:
            raise ValueError("a search needs a term in any or all")
        stats = self.figures(corpus, field)
        rows = self.rows(corpus, field, wanted).select("term", "doc_id", "tf", "dl")
        if stats["segments"]:
            known = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        else:
            known = self.dictionary(corpus, field).where(self._buckets(wanted) & F.col("term").isin(*wanted)).select("term", "df")
        if where is not None:
            rows = rows.join(where.select("doc_id"), "doc_id", "left_semi")
        # one row per query term
        scored = rows.join(F.broadcast(known), "term").withColumn("s", SCORES[score](F.col("tf"), F.col("df"), F.col("dl"), F.lit(stats["n_docs"]), F.lit(stats["avg_dl"])))
        hits = scored.groupBy("doc_id").agg(F.sum("s").alias("score"), F.count(F.when(F.col("term").isin(*all), 1) if all else F.lit(None)).alias("n_all"), F.count(F.when(F.col("term").isin(*any), 1) if any else F.lit(None)).alias("n_any"))
        hits = hits.where((F.col("n_all") == len(all)) & ((F.col("n_any") > 0) if any else F.lit(True))).select("doc_id", "score")
        if none:
            hits = hits.join(self.rows(corpus, field, none).select("doc_id"), "doc_id", "left_anti")
        return top(hits, k)

    def phrase(self, corpus: str, field: str, words: Sequence[str]) -> DataFrame:
        """doc_id, hits: how often the words stand next to each other in this order."""
        rows = self.rows(corpus, field, words).select("doc_id", "term", "positions")
        starts = None
        moved = lambda i: F.transform("positions", lambda p: p - i)
        for i, w in enumerate(words):
            mine = rows.where(F.col("term") == w).select("doc_id", moved(i).alias(f"p{i}"))
            starts = mine.withColumnRenamed("p0", "p") if starts is None else starts.join(mine, "doc_id").select("doc_id", F.array_intersect("p", f"p{i}").alias("p"))
        return starts.where(F.size("p") > 0).select("doc_id", F.size("p").cast("long").alias("hits"))

    def near(self, corpus: str, field: str, a: str, b: str, distance: int) -> DataFrame:
        """doc_id, pairs: places of ``a`` and ``b`` at most ``distance`` words apart."""
        rows = self.rows(corpus, field, [a, b])
        pa, pb = (rows.where(F.col("term") == t).select("doc_id", F.col("positions").alias(n)) for t, n in ((a, "pa"), (b, "pb")))
        pairs = F.aggregate("pa", F.lit(0).cast("long"), lambda n, p: n + F.size(F.filter("pb", lambda q: F.abs(p - q) <= distance)))
        return computed(pa.join(pb, "doc_id"), ["doc_id"], pairs=pairs).where("pairs > 0")

    def with_terms(self, corpus: str, field: str, terms: DataFrame) -> DataFrame:
        """doc_id, n_terms, tf of the documents with any of some rows of the dictionary, as :func:`like` and :func:`fuzzy` choose them."""
        return self.rows(corpus, field).join(terms.select("bucket", "term"), ["bucket", "term"], "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("tf"))

    def wildcard(self, corpus: str, field: str, pattern: str) -> DataFrame:
        """Documents with a term of a pattern in which * stands for any characters and ? for one."""
        return self.with_terms(corpus, field, self.terms_like(corpus, field, pattern))

    def fuzzy(self, corpus: str, field: str, word: str, distance: int) -> DataFrame:
        """Documents with a term within an edit distance of a word."""
        return self.with_terms(corpus, field, self.terms_near(corpus, field, word, distance))

    def terms_like(self, corpus: str, field: str, pattern: str) -> DataFrame:
        """Dictionary terms by a pattern in which * stands for any characters and ? for one.

        By the pattern's grams, if it has any and :meth:`index_terms` has stored them, else by reading the dictionary.
        """
        found = self._looked_up(corpus, field, pattern_keys(pattern), every=True)
        return like(self.dictionary(corpus, field) if found is None else found, pattern)

    def terms_near(self, corpus: str, field: str, word: str, distance: int) -> DataFrame:
        """Dictionary terms within an edit distance of a word, with it.

        By what deletions leave of their fronts, up to a distance of DELETED and if :meth:`index_terms` has stored that, else by reading the dictionary.
        """
        found = self._looked_up(corpus, field, word_keys(word, distance) if distance <= DELETED else [], every=False)
        return fuzzy(self.dictionary(corpus, field) if found is None else found, word, distance)


# the catalog as a corpus


def catalog_text(fields: DataFrame) -> DataFrame:
    """doc_id (subject.path) and text of rows per field: what an index or a scan needs to search the catalog.

    The text is the words of the field's name, also split where small letters change to capitals, and its comment.
    """
    words = F.array_join(identifier_tokens("name"), " ")
    return fields.select(F.concat_ws(".", "subject", "path").alias("doc_id"), F.concat_ws(" ", words, "comment").alias("text"))


def search_catalog(fields: DataFrame, terms: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` fields that fit the terms best: doc_id, score."""
    return top(scan_scores(catalog_text(fields), "doc_id", "text", terms), k)


# the dictionary


def like(terms: DataFrame, pattern: str) -> DataFrame:
    sql = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return terms.where(F.col("term").like(sql))


def fuzzy(terms: DataFrame, word: str, distance: int) -> DataFrame:
    """Terms within an edit distance; lengths are compared first, and the distance stops at its bound."""
    close = F.abs(F.length("term") - len(word)) <= distance
    d = F.levenshtein(F.col("term"), F.lit(word), distance)
    return terms.where(close & (d >= 0)).withColumn("distance", d)


#: Characters of a gram, of a term's front, and of those how many may be deleted.
GRAM, FRONT, DELETED = 3, 7, 2
#: Stand before and behind a term in its grams.
FIRST, LAST = "\u0002", "\u0003"


def lookups(terms: DataFrame, buckets: int) -> DataFrame:
    """key, term, df, cf, home, bucket: a row for each key of a term of a dictionary; ``home`` is the term's own bucket.

    Keys are the term's grams, after a g, and what is left of its first FRONT characters without up to DELETED of them, after a d. If two
    words are at most DELETED edits apart, then they have one of the latter in common: of an alignment's pairs take those inside both
    fronts; what either front has besides them is at most as much as is deleted from its word.
    """
    without = lambda w, i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w)))
    shorter = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: without(w, i))).otherwise(F.array().cast("array<string>"))

    def left(front: Column) -> Column:
        level = every = F.array(front)
        for _ in range(DELETED):
            level = F.array_distinct(F.flatten(F.transform(level, shorter)))
            every = F.concat(every, level)
        return F.transform(F.array_distinct(every), lambda w: F.concat(F.lit("d"), w))

    marked = F.concat(F.lit(FIRST), "term", F.lit(LAST))
    grams = let(marked, lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - (GRAM - 1)), lambda i: F.concat(F.lit("g"), t.substr(i, F.lit(GRAM))))))
    rows = terms.select("term", "df", "cf", F.col("bucket").alias("home"), F.explode(F.concat(grams, let(F.substring("term", 1, FRONT), left))).alias("key"))
    return rows.select("key", "term", "df", "cf", "home", bucket_of(F.col("key"), buckets).alias("bucket"))


def pattern_keys(pattern: str) -> list[str]:
    """The grams that every term of a pattern has."""
    parts = re.split(r"[*?]", FIRST + pattern + LAST)
    return sorted({"g" + p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


def word_keys(word: str, distance: int) -> list[str]:
    """What up to ``distance`` deletions leave of a word's front; any term within the distance has one of them."""
    front = word[:FRONT]
    return sorted({"d" + "".join(kept) for n in range(max(0, len(front) - distance), len(front) + 1) for kept in combinations(front, n)})


def suggest(terms: DataFrame, prefix: str, k: int) -> DataFrame:
    """The ``k`` terms with the prefix that most documents hold."""
    return terms.where(F.col("term").startswith(prefix)).select("term", "df").orderBy(F.desc("df"), "term").limit(k)


def top(hits: DataFrame, k: int | None, digits: int = 4) -> DataFrame:
    """The ``k`` best hits in order; all of them, in no order, if None."""
    rounded = hits.select("doc_id", F.round("score", digits).alias("score"))
    return rounded if k is None else rounded.orderBy(F.desc("score"), "doc_id").limit(k)


# without an index


def _words(docs: DataFrame, id: str, text: str, extra: Sequence[str] = ()) -> DataFrame:
    return computed(docs.withColumn("__id", F.col(id)), ["__id", *extra], words=tokens(text)).withColumnRenamed("__id", "doc_id")


def _has(term: str) -> Column:
    return F.coalesce(F.array_contains("words", term), F.lit(False))


def scan_any(docs: DataFrame, id: str, text: str, terms: Sequence[str]) -> DataFrame:
    return docs.where(F.arrays_overlap(tokens(text), F.array(*map(F.lit, terms)))).select(F.col(id).alias("doc_id"))


def scan_all(docs: DataFrame, id: str, text: str, terms: Sequence[str], none: Sequence[str] = ()) -> DataFrame:
    """Documents with all of ``terms`` and none of ``none``."""
    hits = _words(docs, id, text).where(reduce(lambda a, b: a & b, [_has(t) for t in terms]))
    for t in none:
        hits = hits.where(~_has(t))
    return hits.select("doc_id")


def scan_scores(docs: DataFrame, id: str, text: str, terms: Sequence[str], score: str = "bm25", extra: Sequence[str] = ()) -> DataFrame:
    """doc_id, extra columns, score of every document with a term.

    Texts are read and tokenized once, for a row of numbers each, which are kept; the corpus's figures and then the scores come from those.
    """
    counts = {f"tf{i}": F.coalesce(term_frequency(F.col("words"), t), F.lit(0)) for i, t in enumerate(terms)}
    counted = cut(_words(docs, id, text, extra).select("doc_id", *extra, F.coalesce(F.size("words"), F.lit(0)).alias("dl"), *[c.alias(n) for n, c in counts.items()]))
    figures = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl"), *[F.count(F.when(F.col(n) > 0, 1)).alias(f"df_{n}") for n in counts]).first()
    parts = [F.when(F.col(n) > 0, SCORES[score](F.col(n), F.lit(figures[f"df_{n}"]), F.col("dl"), F.lit(figures["n"]), F.lit(figures["avg_dl"]))).otherwise(0.0) for n in counts]
    hit = reduce(lambda a, b: a | b, [F.col(n) > 0 for n in counts])
    return counted.where(hit).select("doc_id", *extra, sum(parts[1:], parts[0]).alias("score"))


def scan_phrase(docs: DataFrame, id: str, text: str, phrase: Sequence[str]) -> DataFrame:
    """doc_id, hits of a phrase, by looking at each place where its first word stands."""
    follows = lambda i: reduce(lambda a, b: a & b, [F.get("words", i + j) == phrase[j] for j in range(1, len(phrase))], F.lit(True))
    hits = F.size(F.filter("words", lambda x, i: (x == phrase[0]) & F.coalesce(follows(i), F.lit(False))))
    words = _words(docs, id, text).where(reduce(lambda a, b: a & b, [_has(t) for t in dict.fromkeys(phrase)]))
    return computed(words, ["doc_id"], hits=hits.cast("long")).where("hits > 0")


def scan_near(docs: DataFrame, id: str, text: str, a: str, b: str, distance: int) -> DataFrame:
    """doc_id, pairs: places of ``a`` and ``b`` at most ``distance`` words apart."""
    places = lambda t: F.filter(F.transform("words", lambda x, i: F.when(x == t, i)), lambda i: i.isNotNull())
    w = computed(_words(docs, id, text).where(_has(a) & _has(b)), ["doc_id"], pa=places(a), pb=places(b))
    pairs = F.aggregate("pa", F.lit(0).cast("long"), lambda n, p: n + F.size(F.filter("pb", lambda q: F.abs(p - q) <= distance)))
    return computed(w, ["doc_id"], pairs=pairs).where("pairs > 0")


def facets(hits: DataFrame, docs: DataFrame, id: str, column: str) -> DataFrame:
    """value, n: how many hits have each value of a column of their documents."""
    return docs.join(hits.select(F.col("doc_id").alias("__hit")), docs[id] == F.col("__hit"), "left_semi").groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def best_per(hits: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` best hits for each value of a column: column, rank, doc_id, score."""
    rounded = hits.withColumn("score", F.round("score", 4))
    rank = F.row_number().over(Window.partitionBy(column).orderBy(F.desc("score"), "doc_id"))
    return rounded.withColumn("rank", rank).where(F.col("rank") <= n).select(column, "rank", "doc_id", "score")
