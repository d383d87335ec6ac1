"""The longer SQL of this package's queries, for DuckDB."""

from __future__ import annotations

from . import xxh64_sql as X
from .winnowing import BASE, PLACE, PRIME

_VOTES = ", ".join(f"sum(CAST((h >> {b}) & 1 AS BIGINT)) AS b{b}" for b in range(64))
_BITS = " + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(64))

#: Fingerprints by majority vote over shingle hashes; components by following links between distinct fingerprints.
SIMHASH = rf"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingle AS (SELECT row, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
    {X.of_text("shingle", "s", "hashed")},
    votes AS (SELECT row, count(*) AS n, {_VOTES} FROM hashed GROUP BY row),
    prints AS (SELECT doc_id, coalesce(CAST({_BITS} AS UBIGINT), 0::UBIGINT) AS f FROM d LEFT JOIN votes USING (row)),
    nodes AS (SELECT f, min(doc_id) AS rep FROM prints GROUP BY f),
    links AS (SELECT a.rep AS a, b.rep AS b FROM nodes a JOIN nodes b ON a.f <> b.f AND bit_count(xor(a.f, b.f)) <= 3),
    walk(node, seen) AS (SELECT rep, rep FROM nodes UNION SELECT links.b, walk.seen FROM walk JOIN links ON links.a = walk.node),
    component AS (SELECT node, min(seen) AS component_id FROM walk GROUP BY node)
    SELECT doc_id, lpad(lower(hex(f)), 16, '0') AS fingerprint, component_id FROM prints JOIN nodes USING (f) JOIN component ON node = rep
"""


def winnowing(k: int = 3, w: int = 4) -> str:
    """Fingerprints of texts and edited texts, window minima taken as they are defined."""
    unspaced = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
    gram = "u0"
    for j in range(1, k):
        gram = f"(({gram} * {BASE} + u{j}) % {PRIME})"
    grams = ", ".join(f"lead(u, {j}) OVER g AS u{j}" for j in range(k))
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS next,
                      coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM documents),
    t AS (SELECT doc_id, 0 AS edited, text FROM d UNION ALL SELECT doc_id, 1, left(text, length(text) - length(text) // 2) || left(next, length(text) // 2) FROM d),
    listed AS (SELECT doc_id, edited, regexp_extract_all(lower(text), '[{unspaced}]|[^\x20\x09-\x0D{unspaced}]{{1,16}}') AS units FROM t),
    unit AS (SELECT DISTINCT s FROM (SELECT unnest(units) AS s FROM listed)),
    {X.of_text("unit", "s", "known")},
    placed AS (SELECT doc_id, edited, unnest(units) AS s, unnest(range(len(units))) AS i, len(units) AS n FROM listed),
    hashed AS (SELECT doc_id, edited, i, n, CAST((h >> 1) % {PRIME} AS BIGINT) AS u FROM placed JOIN known USING (s)),
    rolled AS (SELECT doc_id, edited, i, {grams} FROM hashed WHERE n >= {k} WINDOW g AS (PARTITION BY doc_id, edited ORDER BY i) QUALIFY u{k - 1} IS NOT NULL),
    -- texts of fewer units than a gram: one gram of them all
    short AS (SELECT doc_id, edited, list(u ORDER BY i) AS us FROM hashed WHERE n < {k} GROUP BY doc_id, edited),
    gram AS (SELECT doc_id, edited, i, {gram} AS h FROM rolled UNION ALL SELECT doc_id, edited, 0, list_reduce(list_prepend(0::BIGINT, us), lambda x, u: (x * {BASE} + u) % {PRIME}) FROM short),
    packed AS (SELECT doc_id, edited, i, (h << {PLACE}) + {2**PLACE - 1} - i AS g, count(*) OVER (PARTITION BY doc_id, edited) AS n FROM gram),
    minima AS (SELECT doc_id, edited, i, n, min(g) OVER (PARTITION BY doc_id, edited ORDER BY i ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS g FROM packed),
    selected AS (SELECT DISTINCT doc_id, edited, g FROM minima WHERE i <= greatest(n - {w}, 0)),
    prints AS (SELECT doc_id, edited, string_agg(lower(hex(g >> {PLACE})) || ':' || CAST({2**PLACE - 1} - (g & {2**PLACE - 1}) AS VARCHAR), ' ' ORDER BY {2**PLACE - 1} - (g & {2**PLACE - 1})) AS line, list_distinct(list(g >> {PLACE})) AS hashes FROM selected GROUP BY doc_id, edited),
    near AS (SELECT d.doc_id, length(d.text) AS n_chars, sha256(left(d.text, length(d.text) - length(d.text) // 2) || left(d.next, length(d.text) // 2)) AS edited_sha256,
                    coalesce(a.line, '') AS fingerprint, coalesce(b.line, '') AS edited_fingerprint, coalesce(a.hashes, []) AS ah, coalesce(b.hashes, []) AS bh, coalesce(c.hashes, []) AS ch
             FROM d LEFT JOIN prints a ON a.doc_id = d.doc_id AND a.edited = 0 LEFT JOIN prints b ON b.doc_id = d.doc_id AND b.edited = 1 LEFT JOIN prints c ON c.doc_id = d.next_id AND c.edited = 0),
    counted AS (SELECT *, len(list_intersect(ah, bh)) AS ab, len(list_intersect(ah, ch)) AS ac FROM near)
    SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
           CASE WHEN len(ah) + len(bh) = 0 THEN 1.0 ELSE ab / CAST(len(ah) + len(bh) - ab AS DOUBLE) END AS near_edited,
           CASE WHEN len(ah) + len(ch) = 0 THEN 1.0 ELSE ac / CAST(len(ah) + len(ch) - ac AS DOUBLE) END AS near_next
    FROM counted
    """


#: Every group's p of every kept word written out, and pairs of groups joined word by word.
DIVERGENCE = r"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
         tok AS (SELECT row, lang, source, unnest(words) AS term FROM d),
         kept AS (SELECT lang, term, count(*) AS n FROM tok GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
         counts AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
         pairs_of AS (SELECT DISTINCT lang, source FROM d),
         size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
         sums AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM pairs_of LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
         dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                     1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // CAST(g.total + s.v AS HUGEINT) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // CAST(s.total + s.v AS HUGEINT) AS lang_p
                   FROM sums g JOIN kept k ON k.lang = g.lang JOIN size s ON s.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
         between_ AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
         pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM pairs_of a JOIN pairs_of b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN between_ x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
         term AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - lang_p) * (p - lang_p) // lang_p AS BIGINT) AS value FROM dense WHERE n > 0 AND p > lang_p),
         ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (FROM pair UNION ALL FROM term))
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

#: Neighbours through what is left of words when a letter is taken out; forms followed one by one.
SPELLING = r"""
    WITH RECURSIVE run AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{6,}')) AS run FROM documents) GROUP BY doc_id, run),
         bytes AS (SELECT doc_id, run, times, list_transform(regexp_extract_all(hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM run),
         hashed AS (SELECT doc_id, run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
                      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, step: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS h FROM bytes),
         damaged AS (SELECT times, CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed),
         words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
         less AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM words, range((SELECT coalesce(max(length(word)), 0) FROM words)) t(i) WHERE i < length(word)),
         pairs AS (SELECT a.word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
                   UNION SELECT a.word, b.word FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word FROM less a JOIN words b ON a.rest = b.word),
         ranked AS (SELECT p.word, p.near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS rank FROM pairs p JOIN words w ON w.word = p.near),
         known AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 5 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 5 * w.n THEN r.near_n END AS form_n
                   FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.rank = 1),
         walk(word, root, onward) AS (SELECT word, word, form FROM known UNION ALL SELECT walk.word, known.word, known.form FROM walk JOIN known ON known.word = walk.onward)
    SELECT k.word, k.form, w.root, k.n, k.n_near, k.form_n FROM known k JOIN walk w ON w.word = k.word AND w.onward IS NULL
"""

#: Digests in base 32 from five bits of SHA-1 at a time.
WARC = r"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
         g AS (SELECT page_id, html, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
    SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
               (16 * (strpos('0123456789abcdef', substr(h, CAST(5 * i // 4 + 1 AS INT), 1)) - 1) + strpos('0123456789abcdef', substr(h, CAST(5 * i // 4 + 2 AS INT), 1)) - 1)
               // CAST(pow(2, 3 - 5 * i % 4) AS BIGINT) % 32 AS INT), 1)), '') AS payload_digest,
           CASE WHEN page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to FROM g
"""
