"""The models of quality resampling and language identification against versions written out letter by letter and word by word."""

import math
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest

from terrane.llm import importance, langid

MASK = 2**64 - 1


def scramble(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_buckets(text, buckets):
    """A bucket for each word or run of marks, and for each two that follow each other."""
    random_of = [int(x) for x in np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    hashes = []
    for token in re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+|[!-/:-@\[-^`{-\x7f]+", text):
        data, h, power = token.encode(), 0, 1
        for b in data:
            h = h + random_of[b] * power & MASK
            power = power * 0x9E3779B97F4A7C15 & MASK
        hashes.append(scramble(h + len(data) & MASK))
    pairs = [scramble(a * 3 + scramble(b) & MASK) for a, b in zip(hashes, hashes[1:])]
    return [h % buckets for h in hashes + pairs]


def test_resampling_equals_plain(spark, docs, rows):
    buckets, seed, share = 500, 5, 0.3
    good = {i for i, *_ in rows if i is not None and 100 <= i < 140} | {4, 8}
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(5, 1, 1), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = importance.resample(docs, labels, share=share, buckets=buckets, seed=seed).collect()
    of = [plain_buckets(t, buckets) for _, t, *_ in rows]
    raw, target = Counter(), Counter()
    for (i, *_), b in zip(rows, of, strict=True):
        raw.update(b)
        if i in good:
            target.update(b)
    p = lambda counts, x: (counts[x] + 1) / (sum(counts.values()) + buckets)
    ratio = [math.log(p(target, x)) - math.log(p(raw, x)) for x in range(buckets)]
    weights = [sum(ratio[x] for x in b) for b in of]
    ids = spark.createDataFrame([(n, r[0]) for n, r in enumerate(rows)], "n int, doc_id long")
    noise = {r["n"]: r["noise"] for r in ids.selectExpr("n", f"xxhash64({seed}, doc_id) noise").collect()}
    keys = [w - math.log(-math.log(min(max((scramble(noise[n] & MASK) + 0.5) / 2**64, 1e-300), 1 - 2**-53))) for n, w in enumerate(weights)]
    least = sorted(keys, reverse=True)[round(share * len(rows)) - 1]
    order = lambda r: (r[0] is not None, r[0] or 0, round(r[1], 6))
    want = sorted(((i, w, k, k >= least) for (i, *_), w, k in zip(rows, weights, keys, strict=True)), key=order)
    got = sorted(map(tuple, got), key=order)
    assert [r[0] for r in got] == [r[0] for r in want] and [r[3] for r in got] == [r[3] for r in want]
    assert [r[1] for r in got] == pytest.approx([r[1] for r in want], rel=1e-9, abs=1e-9)
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], rel=1e-9, abs=1e-9)


def symbol(c):
    if not c.isalpha():
        return 0
    return ord(c) - 96 if "a" <= c <= "z" else 27 + (ord(c) * 2654435761 >> 7) % 101


def plain_bundle(text, n, dims, seed):
    """The sum over letter n-grams of the product of the letters' vectors, the k-th of them rotated by n - 1 - k."""
    base = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (128, dims)).astype(np.int64)
    stream = [0]
    for c in (text or "").lower():
        x = symbol(c)
        if x or stream[-1]:
            stream.append(x)
    stream += [0] if stream[-1] else []
    total = np.zeros(dims, np.int64)
    for gram, times in Counter(zip(*(stream[k:] for k in range(n)))).items():
        bound = np.ones(dims, np.int64)
        for k, x in enumerate(gram):
            bound = bound * np.roll(base[x], n - 1 - k)
        total += times * bound
    return total if any(stream) else 0 * total


def test_languages_equal_plain(spark, docs, rows):
    n, dims, seed = 3, 64, 9
    bundles = [plain_bundle(t, n, dims, seed) for _, t, *_ in rows]
    want = {}
    for (_, t, lang, *_), b in zip(rows, bundles, strict=True):
        if t is not None and lang is not None:
            want[lang] = want.get(lang, 0) + b
    names = sorted(want)
    languages, prototypes = langid.learn(docs, n=n, dims=dims, seed=seed)
    assert languages == names and (prototypes == np.array([want[x] for x in names])).all()
    judged = []
    for (i, *_), b in zip(rows, bundles, strict=True):
        cosines = [min(1, max(0, b @ want[x] / np.linalg.norm(b) / np.linalg.norm(want[x]))) for x in names] if b.any() else [0]
        # languages whose cosines single precision can't tell apart are all right
        judged.append((i, {x for x, c in zip(names, cosines) if c > max(cosines) - 1e-5} if b.any() else {"und"}, max(cosines)))
    from pyspark.sql import functions as F

    got = langid.predict_languages(docs, languages, prototypes, n=n, seed=seed, keep=[F.col("doc_id")]).collect()
    order = lambda r: (r[0] is not None, r[0] or 0, r[2])
    got, judged = sorted(map(tuple, got), key=order), sorted(judged, key=order)
    assert [r[0] for r in got] == [r[0] for r in judged] and all(g[1] in j[1] for g, j in zip(got, judged))
    assert sum(len(j[1]) == 1 for j in judged) > len(judged) // 2
    assert [r[2] for r in got] == pytest.approx([r[2] for r in judged], abs=1e-5)


def test_slices_of_kinds_change_nothing(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400)) for _ in range(5)] + ["a b", "", None]
    whole = langid.bundles(texts, 3, 32, 1)
    monkeypatch.setattr(langid, "KINDS", 50)
    assert (langid.bundles(texts, 3, 32, 1) == whole).all()


def test_memory_of_many_letters():
    """Texts of thousands of letters have nearly as many kinds of n-grams as places."""
    code = """if True:
        import random, resource
        from terrane.llm import langid
        rng = random.Random(1)
        texts = ["".join(chr(0x4E00 + rng.randrange(8000)) for _ in range(1600)) for _ in range(244)]
        langid.bundles(["warm"], 3, 512, 6)
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        langid.bundles(texts, 3, 512, 6)
        print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
    """
    grown = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120).stdout.split()[-1])
    assert grown < 220
