"""Language identification by hyperdimensional profiles.

Every letter symbol has a random bipolar vector. A letter n-gram is bound from its letters: the
elementwise product of their vectors, each rotated by its place in the n-gram. A text is the bundle, that is the
sum, of its n-grams' vectors; a language is the bundle of its texts. A text is compared with the
languages by cosine. Words are bracketed by blanks and cased down; anything but letters only
separates words.

A batch of texts is bundled as (texts x n-grams seen) counts times (n-grams seen x dimensions) vectors, a slice of the n-grams at a time
and their vectors made from the letter vectors when needed: memory is bounded whatever the script. Learning sums integer bundles by
language inside each task and then over tasks; only one vector a language reaches the driver, and their number
is checked against ``max_languages`` before it is.

Defined cases: a very long text is bundled whole, by itself; a null text, or one without a letter, is ``und`` with score 0, and so is every text when nothing was learned;
ties go to the language first by code point; an empty table gives an empty result; repeated rows are judged alike.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out_of, learns, small_batches

UNDETERMINED = "und"
#: Symbols: 0 separates words, 1 to 26 are a to z, all other letters share the rest by code point.
SYMBOLS = 128
#: Texts are bundled in groups of at most so many symbols, or one text.
GROUP = 400_000
#: Vectors of so many kinds of n-grams exist at once.
KINDS = 8192


@functools.cache
def _symbols() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            table[cp] = cp - 96 if 97 <= cp <= 122 else 27 + (cp * 2654435761 >> 7) % (SYMBOLS - 27)
    return table


@functools.cache
def _letters(dims: int, n: int, seed: int) -> list[np.ndarray]:
    """For each place in an n-gram, the symbols' vectors rotated by that place."""
    base = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (SYMBOLS, dims))
    return [np.roll(base, n - 1 - place, axis=1) for place in range(n)]


def symbols_of(text: str) -> np.ndarray:
    """The symbols of a text, one separator before, between and after words; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _symbols()[points]
    if not s.any():
        return s[:0]
    s = np.concatenate(([0], s, [0])).astype(np.uint8)
    return s[(s != 0) | np.concatenate(([True], s[1:] != s[:-1]))]


def bundles(texts: list[str | None], n: int, dims: int, seed: int) -> np.ndarray:
    """(texts, dims) sums of the texts' n-gram vectors; zero rows for texts without letters."""
    out, i = np.zeros((len(texts), dims), np.float32), 0
    streams = [symbols_of(t) if t else np.zeros(0, np.uint8) for t in texts]
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(streams[j]) <= GROUP) and j - i < 256:
            total += len(streams[j])
            j += 1
        out[i:j] = _bundle(streams[i:j], n, dims, seed)
        i = j
    return out


def _bundle(streams: list[np.ndarray], n: int, dims: int, seed: int) -> np.ndarray:
    grams = [max(0, len(s) - n + 1) for s in streams]
    total = sum(grams)
    if not total:
        return np.zeros((len(streams), dims), np.float32)
    codes, at = np.empty(total, np.int32), 0
    for s, m in zip(streams, grams, strict=True):
        if m:
            code = s[:m].astype(np.int32)
            for k in range(1, n):
                code = code * SYMBOLS + s[k : k + m]
            codes[at : at + m] = code
            at += m
    seen = np.zeros(SYMBOLS**n, bool)
    seen[codes] = True
    kinds = np.flatnonzero(seen)
    place = np.empty(SYMBOLS**n, np.int32)
    place[kinds] = np.arange(len(kinds), dtype=np.int32)
    places, owner = place[codes], np.repeat(np.arange(len(streams), dtype=np.int64), grams)
    if len(kinds) > KINDS:
        order = np.argsort((places // KINDS).astype(np.uint16), kind="stable")
        places, owner = places[order], owner[order]
    out, at = np.zeros((len(streams), dims), np.float32), 0
    for first in range(0, len(kinds), KINDS):
        here = kinds[first : first + KINDS]
        end = int(np.searchsorted(places // KINDS, first // KINDS, "right")) if len(kinds) > KINDS else total
        counts = np.bincount(owner[at:end] * len(here) + (places[at:end] - first), minlength=len(streams) * len(here))
        out += counts.reshape(len(streams), -1).astype(np.float32) @ _bound(here, n, dims, seed)
        at = end
    return out


def _bound(kinds: np.ndarray, n: int, dims: int, seed: int) -> np.ndarray:
    """The vectors of n-grams, bound from those of their letters."""
    vectors = None
    for letters in reversed(_letters(dims, n, seed)):
        vectors = letters[kinds % SYMBOLS] if vectors is None else vectors * letters[kinds % SYMBOLS]
        kinds = kinds // SYMBOLS
    return vectors


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", n: int = 3, dims: int = 512, seed: int = 6, max_languages: int = 4096) -> tuple[list[str], np.ndarray]:
    """The languages, by code point, and their prototypes (languages, dims)."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in it:
            langs = np.array(batch.column(1).to_pylist(), object)
            b = bundles(batch.column(0).to_pylist(), n, dims, seed)
            for name in set(langs.tolist()):
                part = b[langs == name].sum(axis=0, dtype=np.float64)
                total[name] = total[name] + part if name in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.astype(np.int64).tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "sums"])

    parts = rows.mapInArrow(sums, "lang string, sums array<long>")
    # one row a (task, language): their sums by place, and only then one row a language on the driver
    by_place = parts.select("lang", F.posexplode("sums").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    whole = by_place.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("v")).select("lang", F.col("v.x").alias("v"))
    found = whole.limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages are labelled")
    found.sort(key=lambda r: r["lang"].encode())
    return [r["lang"] for r in found], np.array([r["v"] for r in found], np.float64).reshape(len(found), dims)


def predictor(languages: list[str], prototypes: np.ndarray, n: int = 3, seed: int = 6):
    """A function from a list of texts to (languages predicted, scores)."""
    dims = prototypes.shape[1]
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = (prototypes / np.where(norms > 0, norms, 1)).astype(np.float32)

    def predict(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        b = bundles(texts, n, dims, seed)
        size = np.linalg.norm(b, axis=1)
        if not languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        cos = (b @ unit.T) / np.where(size > 0, size, 1)[:, None]
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(texts)), best], 0, 1).astype(np.float64)
        return [languages[k] if z > 0 else UNDETERMINED for k, z in zip(best.tolist(), size.tolist(), strict=True)], np.where(size > 0, score, 0.0)

    return predict


def predict_languages(docs: DataFrame, languages: list[str], prototypes: np.ndarray, text: str = "text", n: int = 3, seed: int = 6, keep: list[Column] | None = None) -> DataFrame:
    """``keep`` columns of every row with lang_pred and score."""
    small_batches(docs.sparkSession)
    kept = docs.select(F.col(text).cast("string").alias("__text"), *(keep or []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(languages, prototypes, n, seed)
        for batch in it:
            langs, scores = predict(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], "lang_pred", "score"])

    return kept.mapInArrow(batches, f"{schema}{', ' * bool(schema)}lang_pred string, score double")


def keep_identified(docs: DataFrame, languages: list[str], prototypes: np.ndarray, least: float = 0.02, text: str = "text", n: int = 3, seed: int = 6) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is determined with a score of ``least`` or more."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(languages, prototypes, n, seed)
        for batch in it:
            langs, scores = predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([name != UNDETERMINED and score >= least for name, score in zip(langs, scores.tolist(), strict=True)], pa.bool_()))

    # by place, as names may be of any kind
    places = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return places.mapInArrow(batches, places.schema).toDF(*docs.columns)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", modulus: int = 4, **how) -> DataFrame:
    """Learns from the documents that are not held out and judges all: doc_id, held_out, lang_pred, score."""
    languages, prototypes = learn(docs.where(learns(F.col(doc_id), modulus)), text, lang, **how)
    keep = [F.col(doc_id).alias("doc_id"), held_out_of(F.col(doc_id), modulus).alias("held_out")]
    same = {k: v for k, v in how.items() if k in ("n", "seed")}
    return predict_languages(docs, languages, prototypes, text, keep=keep, **same)
