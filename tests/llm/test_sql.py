import random

import duckdb
import xxhash

from terrane.llm.xxh64_sql import of_text


def test_xxh64():
    rng = random.Random(1)
    texts = ["", "a", "abcd", "abcdefgh", "é" * 5, "x" * 31, "x" * 32, "y" * 33, "z" * 64, "q" * 100, *("".join(rng.choice("abc é") for _ in range(rng.randrange(90))) for _ in range(200))]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    got = con.sql(f"WITH {of_text('t', 's', 'o')} SELECT h FROM o ORDER BY i").fetchall()
    assert [h for (h,) in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]
