"""The registered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from .ann import op1_multi_index_hashing
from .collocations import op11_collocations
from .decontam import op10_decontamination
from .exact_dedup import op13_exact_dedup
from .fill_in_middle import op12_fill_in_middle
from .langid import op2_language_id
from .line_dedup import op5_line_dedup
from .ngram_join import op4_ngram_join
from .packing import op3_best_fit_packing
from .pii import op6_pii
from .quality import op9_quality
from .secrets import op8_secrets
from .substring_dedup import op7_substring_dedup

QUERIES = {
    "op1_multi_index_hashing": op1_multi_index_hashing,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ngram_join": op4_ngram_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_pii": op6_pii,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_secrets": op8_secrets,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
    "op11_collocations": op11_collocations,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_exact_dedup": op13_exact_dedup,
}
ORACLES: dict[str, str] = {
    # every window of 13 words, the least document that holds it, and the words that later ones lose
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spot AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM spot),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (k) WHERE doc_id > m),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p WHERE gone.p IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    # every window of 3 lines, and of 1 or 2 that hold 50 words, and its first place; a text that loses nothing is hashed as it is
    "op5_line_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS w FROM documents),
size AS (SELECT unnest([1, 2, 3]) AS g),
spot AS (SELECT doc_id, w, g, unnest(range(1, len(w) - g + 2)) AS i FROM d, size),
win AS (SELECT doc_id, i, g, array_to_string(w[i:i + g - 1], chr(10)) AS k FROM spot WHERE g = 3 OR len(regexp_extract_all(array_to_string(w[i:i + g - 1], chr(10)), '[^\x20\x09-\x0D]+')) >= 50),
first AS (SELECT k, g, min((doc_id, i)) AS m FROM win GROUP BY k, g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + g)) AS p FROM win JOIN first USING (k, g) WHERE (doc_id, i) > m),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, chr(10) ORDER BY word.p) AS t, count(*) AS n FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p WHERE gone.p IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_lines, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(CASE WHEN len(w) = coalesce(n, 0) THEN text ELSE coalesce(t, '') END) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    # all pairs with a common n-gram; what links reach, by closure
    "op4_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
spot AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS k FROM spot),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM common JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 5 * m >= 4 * (cx.n + cy.n - m)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT e.x, reach.r FROM reach JOIN e ON e.y = reach.doc_id),
n AS (SELECT x, count(*) AS n FROM e GROUP BY 1)
SELECT reach.doc_id, min(r) AS class_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links FROM reach LEFT JOIN n ON n.x = reach.doc_id GROUP BY 1""",
    # every window that shares an n-gram with an item of its size, without fingerprints
    "op10_decontamination": r"""
WITH t AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') FROM benchmark),
spot AS (SELECT side, id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS p FROM t WHERE len(w) > 0),
g AS (SELECT side, id, p, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[p + 1:p + 5], ' ') END AS k, greatest(len(w) - 4, 1) AS n FROM spot),
own AS (SELECT id AS item_id, k, n, count(*) AS c FROM g WHERE side = 'i' GROUP BY 1, 2, 3),
hit AS (SELECT g.id AS doc_id, item_id, p, g.n AS m, own.n, g.k, c FROM g JOIN own ON g.k = own.k WHERE side = 'd'),
win AS (SELECT DISTINCT doc_id, item_id, m, n, unnest(range(greatest(0, p - n + 1), least(p, greatest(0, m - n)) + 1)) AS s FROM hit),
mine AS (SELECT win.doc_id, win.item_id, win.m, win.n, s, k, least(count(*), any_value(c)) AS c FROM win JOIN hit ON win.doc_id = hit.doc_id AND win.item_id = hit.item_id AND p >= s AND p < s + win.n GROUP BY 1, 2, 3, 4, 5, 6),
sim AS (SELECT doc_id, item_id, s, n, least(m, n) AS len, sum(c) AS common FROM mine GROUP BY 1, 2, 3, 4, 5),
best AS (SELECT doc_id, item_id, max((common / (len + n - common), s, len)) AS b FROM sim WHERE common / (len + n - common) >= 0.8 GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(b[2] AS INTEGER) AS start, CAST(b[3] + 4 AS INTEGER) AS n_words, CAST(b[1] AS DOUBLE) AS similarity FROM best""",
    # every phrase, both parts of every cut in 128 bits, and every longer phrase that contains it
    "op11_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
size AS (SELECT unnest([1, 2, 3]) AS g),
spot AS (SELECT lang, w, g, unnest(range(1, len(w) - g + 2)) AS i FROM p, size),
f AS (SELECT lang, g, array_to_string(w[i:i + g - 1], ' ') AS phrase, count(*) AS f FROM spot GROUP BY 1, 2, 3),
cut AS (SELECT lang, phrase, g, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, g)) AS k FROM f WHERE g > 1 AND f >= 10),
score AS (SELECT c.lang, c.phrase, c.g, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
low AS (SELECT lang, phrase, g, a, min((score, k, l, r)) AS b FROM score GROUP BY 1, 2, 3, 4),
taken AS (SELECT DISTINCT s.lang, s.phrase FROM low s JOIN (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS part FROM f WHERE g = 3 AND f >= 10) u ON u.lang = s.lang AND u.part = s.phrase WHERE s.g = 2 AND 100 * u.f >= 50 * s.a),
ranked AS (SELECT low.*, row_number() OVER (PARTITION BY lang ORDER BY b[1] DESC, a DESC, encode(phrase)) AS rank FROM low ANTI JOIN taken USING (lang, phrase))
SELECT lang, rank, phrase, a, b[3] AS l, b[4] AS r, n, CAST(b[1] AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    # code points by DuckDB's own functions; the text is rebuilt from its three parts
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
v AS (SELECT doc_id, x, CAST(length(x) AS BIGINT) AS n, [CAST('0x' || h[8 * k + 1:8 * k + 8] AS BIGINT) for k in range(4)] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS i, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS j FROM v),
f AS (SELECT *, CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, substring(x, 1, i) AS p, substring(x, i + 1, j - i) AS m, substring(x, j + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars, sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(p || m || s) AS restored_sha256 FROM f""",
    # equal rows with equal ids count as one row that stays
    "op13_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, row_number() OVER () AS i FROM documents),
k AS (SELECT doc_id, i, length(x) AS n, sha256(regexp_replace(x, '[ 	-]', '', 'g')) AS h FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST, i) AS o FROM k)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, o = 1 AS kept, h AS text_sha256 FROM r WINDOW g AS (PARTITION BY h ORDER BY o)""",
}
