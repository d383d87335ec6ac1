"""The pipeline, stage by stage on written tables as it runs, against plain versions of its stages."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from terrane.llm import langid, packing

from .plain import plain_targets
from .test_near import plain_near_rows

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_languages(rows):
    """Prototypes from the labelled documents that are not held out, as sums of whole bundles."""
    learned = collections.defaultdict(lambda: np.zeros(512))
    for r in rows:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        if not held and r["lang"] is not None and r["text"] is not None:
            learned[r["lang"]] += langid.bundles([r["text"]], 3, 512, 6)[0]
    names = sorted(learned, key=str.encode)
    return names, np.array([learned[n] for n in names])


def plain_stages(rows):
    """The rows that leave each of the first three stages."""
    predict = langid.predictor(*plain_languages(rows))
    langs, scores = predict([r["text"] for r in rows])
    first = [r for r, name, score in zip(rows, langs, scores) if name != "und" and score >= 0.02]
    groups = collections.defaultdict(list)
    for r in first:
        groups[SPACE.sub(" ", r["text"])].append(r)
    second = [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]
    return first, second, plain_near_rows(second)


@pytest.fixture(scope="module", params=["cases", "table"])
def table(request, spark, docs, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp(request.param))
    (docs if request.param == "cases" else spark.read.parquet(f"{sf}/documents.parquet")).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    rows, columns = docs.collect(), docs.columns
    wanted = plain_stages(rows)
    key = lambda rs: sorted((repr(r["doc_id"]), hashlib.sha256(SPACE.sub(" ", r["text"] or "").encode()).hexdigest()) for r in rs)
    for n, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, table)
        out.write.parquet(f"{table}/{name}")
        docs = spark.read.parquet(f"{table}/{name}")
        got = docs.collect()
        if n < 4:
            assert docs.columns == columns
        if n < 3:
            assert key(got) == key(wanted[n])
    # mixing: each source near its target by whole documents, no document over three times
    third = wanted[2]
    mixed = spark.read.parquet(f"{table}/{P.STAGES[3][0]}").collect()
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in third:
        sizes[r["source"]] += size(r["text"])
        largest[r["source"]] = max(largest[r["source"]], size(r["text"]))
    for r in mixed:
        taken[r["source"]] += size(r["text"])
    for s, target in plain_targets(sizes).items():
        assert abs(taken[s] - target) <= largest[s] / 2 + 1
    times = collections.Counter(key(mixed))
    assert set(times) <= set(key(third)) and max(times.values()) <= 3
    # packing: every id of every taken document once, in order
    tokenize = packing.Tokenize.at(packing.public_tokenizer())
    tokens = collections.Counter()
    for r, ids in zip(mixed, tokenize([r["text"] for r in mixed])):
        tokens[r["doc_id"]] += len(ids) // 4 + 1
    pieces = spark.read.parquet(f"{table}/{P.STAGES[4][0]}").collect()
    packed, fill = collections.Counter(), collections.Counter()
    for p in pieces:
        packed[p["doc_id"]] += p["length"]
        fill[p["sequence_id"]] += p["length"]
    assert packed == tokens and max(fill.values()) <= 4096
    # and the pieces, put together, are token sequences
    read = lambda n: spark.read.parquet(f"{table}/{P.STAGES[n][0]}")
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(read(3), read(4)).collect()}
    for p in pieces:
        assert zlib.crc32(np.array(whole[p["sequence_id"]][p["offset"] : p["offset"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
    assert {k: len(v) for k, v in whole.items()} == fill
    # run() is the same stages in one go
    whole = P.run(spark, table).collect()
    assert collections.Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"]) for p in whole) == collections.Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"]) for p in pieces)


def test_empty(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
