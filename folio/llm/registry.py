"""The training-data queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm.op01_substring_dedup import op1_substring_dedup
from folio.llm.op02_ann import op2_ann
from folio.llm.op03_pii import op3_pii
from folio.llm.op04_media import op4_media
from folio.llm.op05_line_dedup import op5_line_dedup
from folio.llm.op06_simhash import op6_simhash
from folio.llm.op07_mixing import SQL as _MIXING
from folio.llm.op07_mixing import op7_mixing
from folio.llm.op08_suffix_dedup import op8_suffix_dedup
from folio.llm.op09_packing import op9_packing
from folio.llm.op10_quality import op10_quality
from folio.llm.op11_periodic_runs import op11_periodic_runs
from folio.llm.op12_prefix_trie import SQL as _TRIE
from folio.llm.op12_prefix_trie import op12_prefix_trie
from folio.llm.op13_embedding_dedup import SQL as _LINKED
from folio.llm.op13_embedding_dedup import op13_embedding_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_ann,
        op3_pii,
        op4_media,
        op5_line_dedup,
        op6_simhash,
        op7_mixing,
        op8_suffix_dedup,
        op9_packing,
        op10_quality,
        op11_periodic_runs,
        op12_prefix_trie,
        op13_embedding_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_mixing": _MIXING,
    "op12_prefix_trie": _TRIE,
    "op13_embedding_dedup": _LINKED,
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
m AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
hit AS (SELECT g.doc_id, p FROM g JOIN m USING (k) WHERE first < g.doc_id),
gone AS (SELECT DISTINCT doc_id, p + i AS p FROM hit, range(0, 13) AS r(i)),
word AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM (SELECT doc_id, w FROM d WHERE len(w) > 0)),
kept AS (SELECT word.doc_id, word.p, w[word.p] AS t, gone.p IS NOT NULL AS r FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p),
runs AS (SELECT *, r AND NOT coalesce(lag(r) OVER (PARTITION BY doc_id ORDER BY p), false) AS new FROM kept),
s AS (SELECT doc_id, count(*) AS n, sum(r::int) AS removed, sum(new::int) AS spans, string_agg(t, ' ' ORDER BY p) FILTER (WHERE NOT r) AS t FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(spans, 0)::BIGINT AS n_spans
FROM d LEFT JOIN s USING (doc_id)""",
    "op5_line_dedup": r"""
WITH l AS (SELECT doc_id, i, ls[i] AS line, ls[i] <> '' AS solid FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
u AS (SELECT doc_id, i, line, 1 + (n >= 25)::INT + (n >= 50)::INT AS weight FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE solid)),
p AS (SELECT doc_id, i, line, j, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS t FROM (SELECT *, unnest(range(0, weight)) AS j FROM u)),
w AS (SELECT doc_id, t, line AS l0, j AS j0, lead(line) OVER o AS l1, lead(j) OVER o AS j1, lead(line, 2) OVER o AS l2, lead(j, 2) OVER o AS j2 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY t)),
hit AS (SELECT doc_id, t FROM (SELECT doc_id, t, row_number() OVER (PARTITION BY l0, j0, l1, j1, l2, j2 ORDER BY doc_id, t) AS k FROM w WHERE l2 IS NOT NULL) WHERE k > 1),
gone AS (SELECT DISTINCT p.doc_id, p.i FROM p JOIN (SELECT doc_id, t + unnest([0, 1, 2]) AS t FROM hit) h ON h.doc_id = p.doc_id AND h.t = p.t),
m AS (SELECT l.*, CASE WHEN solid THEN gone.i IS NOT NULL END AS g FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i),
r AS (SELECT *, coalesce(g, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AND coalesce(first_value(g IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false)) AS out FROM m)
SELECT doc_id, count(*) FILTER (WHERE g)::BIGINT AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT out), '')) AS kept_sha256 FROM r GROUP BY doc_id""",
    "op8_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
t AS (SELECT doc_id, i, substr(h, (2000 * i + 1)::BIGINT, 2198) AS t FROM (SELECT doc_id, h, unnest(range(0, (length(h) + 1999) // 2000)) AS i FROM d WHERE h <> '')),
b AS (SELECT doc_id, 1000 * i + q AS p, substr(t, (2 * q + 1)::BIGINT, 2) AS c, CASE WHEN length(t) >= 2 * q + 200 THEN substr(t, (2 * q + 1)::BIGINT, 200) END AS k FROM (SELECT *, unnest(range(0, least(1000, length(t) // 2))) AS q FROM t)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM b WHERE k IS NOT NULL) WHERE n > 1),
m AS (SELECT b.doc_id, b.p, b.c, coalesce(b.p - last_value(hit.p IGNORE NULLS) OVER (PARTITION BY b.doc_id ORDER BY b.p) < 100, false) AS gone FROM b LEFT JOIN hit ON hit.doc_id = b.doc_id AND hit.p = b.p),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS new FROM m),
s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE new) AS spans, string_agg(c, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)""",
}
