"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from goldpan.llm.ann import op1_cross_polytope
from goldpan.llm.language import op5_language
from goldpan.llm.licences import op3_licences
from goldpan.llm.line_dedup import op10_line_dedup
from goldpan.llm.lm import op4_pseudo_likelihood
from goldpan.llm.mixing import op7_mixing
from goldpan.llm.packing import op8_packing
from goldpan.llm.passages import op6_passages
from goldpan.llm.simhash import op2_simhash
from goldpan.llm.substrings import op6_substrings
from goldpan.llm.topk import op9_pivot_topk

QUERIES = {
    "op1_cross_polytope": op1_cross_polytope,
    "op2_simhash": op2_simhash,
    "op3_licences": op3_licences,
    "op4_pseudo_likelihood": op4_pseudo_likelihood,
    "op5_language": op5_language,
    "op6_substrings": op6_substrings,
    "op6_passages": op6_passages,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_pivot_topk": op9_pivot_topk,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE = {}

ORACLE["op7_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source
), w AS (SELECT *, (r % 3 + 1)::BIGINT AS w, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
          / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM w WINDOW b AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (SELECT source, source_size, least(cap::DOUBLE, w * max(level) OVER ()) AS target FROM l),
c AS (
  SELECT d.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS sent
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), f AS (
  SELECT doc_id, k, size, e, (e * source_size + sent)::DOUBLE / target AS time
  FROM c, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0
), g AS (
  SELECT *, sum(size) OVER (ORDER BY time, k, doc_id, e ROWS UNBOUNDED PRECEDING) AS pos FROM f
), n AS (
  SELECT doc_id, count(*) AS copies FROM g WHERE pos <= (SELECT sum(size) FROM d) GROUP BY doc_id
)
SELECT c.doc_id, c.size, c.source_size, c.target, (c.size * coalesce(n.copies, 0))::BIGINT AS taken
FROM c LEFT JOIN n USING (doc_id)
"""

ORACLE["op10_line_dedup"] = r"""
WITH d AS (SELECT doc_id, text FROM documents),
l AS (
  SELECT doc_id, generate_subscripts(x, 1) - 1 AS no, unnest(x) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM d WHERE text IS NOT NULL)
), w AS MATERIALIZED (
  SELECT doc_id, no, list_sort(list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'))) AS w FROM l
), s AS MATERIALIZED (
  SELECT row_number() OVER () AS id, w, len(w) AS n, min((doc_id, no)) AS place FROM w WHERE len(w) > 0 GROUP BY w
), t AS (SELECT id, n, place, unnest(w) AS t FROM s),
f AS (SELECT t, count(*) AS f FROM t GROUP BY t),
p AS MATERIALIZED (
  SELECT id, n, place, t FROM (
    SELECT t.*, row_number() OVER (PARTITION BY id ORDER BY f, t.t) AS r FROM t JOIN f ON t.t = f.t
  ) WHERE r <= n - (n * 80 + 99) // 100 + 1
), c AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.t = b.t AND a.place < b.place AND a.n * 10 >= b.n * 8 AND b.n * 10 >= a.n * 8
), m AS (
  SELECT DISTINCT b FROM c JOIN s x ON x.id = c.a JOIN s y ON y.id = c.b
  WHERE len(list_intersect(x.w, y.w)) * 180 >= (x.n + y.n) * 80
), g AS (
  SELECT w.doc_id, w.no, s.id IS NOT NULL AND (m.b IS NOT NULL OR (w.doc_id, w.no) <> s.place) AS gone
  FROM w LEFT JOIN s ON w.w = s.w LEFT JOIN m ON m.b = s.id
)
SELECT d.doc_id, count(g.no) AS n_lines, count(*) FILTER (gone) AS n_removed,
       coalesce(string_agg(g.no::VARCHAR, ',' ORDER BY g.no) FILTER (gone), '') AS removed
FROM d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY d.doc_id
"""

ORACLE["op6_substrings"] = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) AS k, unnest(x) AS piece
  FROM (SELECT doc_id, regexp_extract_all(text, '(?:[^\n.!?]+|[.!?]+[^\x20\x09-\x0D.!?])+[.!?]*|[.!?]+|\n') AS x FROM documents WHERE text IS NOT NULL)
), o AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(piece) AS begin,
         length(regexp_extract(piece, '^[\x20\x09\x0B-\x0D]*')) AS lead, length(regexp_extract(piece, '[\x20\x09\x0B-\x0D]*$')) AS trail,
         regexp_extract_all(lower(piece), '[^\x20\x09-\x0D]+') AS w FROM l
), u AS (
  SELECT doc_id, begin + lead AS start, length(piece) - lead - trail AS length, len(w) AS words, list_aggregate(w, 'string_agg', ' ') AS t,
         row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS unit FROM o WHERE len(w) > 0
), r AS (
  SELECT *, first_value(doc_id) OVER x AS keeper_id, first_value(start) OVER x AS keeper_start, row_number() OVER x AS r
  FROM u WINDOW x AS (PARTITION BY t ORDER BY doc_id, start)
), p AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM r WHERE r > 1),
q AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, run) AS total FROM p)
SELECT doc_id, unit::INT AS unit, start::BIGINT AS start, length::BIGINT AS length, words::INT AS words,
       keeper_id, keeper_start::BIGINT AS keeper_start FROM q WHERE total >= 30
"""

ORACLE["op9_pivot_topk"] = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, max(list_inner_product(q.v, x.v)::BIGINT) AS score
  FROM e q JOIN e x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
