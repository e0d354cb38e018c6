"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelmint.llm.codes import op13_vector_codes
from parcelmint.llm.langid import op3_language_id
from parcelmint.llm.mixing import op1_mixing
from parcelmint.llm.neardup import op8_embedding_neardup
from parcelmint.llm.ngram_join import op10_ngram_jaccard
from parcelmint.llm.packing import op4_packing
from parcelmint.llm.quality import op5_quality
from parcelmint.llm.secrets import op9_secret_scans
from parcelmint.llm.stages import run
from parcelmint.llm.toxicity import op7_toxicity
from parcelmint.llm.urls import op6_url_filters
from parcelmint.llm.vptree import op2_nearest
from parcelmint.llm.warc import op12_warc
from parcelmint.llm.whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_nearest": op2_nearest,
    "op3_language_id": op3_language_id,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_url_filters": op6_url_filters,
    "op7_toxicity": op7_toxicity,
    "op8_embedding_neardup": op8_embedding_neardup,
    "op9_secret_scans": op9_secret_scans,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_whitening": op11_whitening,
    "op12_warc": op12_warc,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": run,
}

#: Rules that fit a page, the longest first; a page without one gets its host's verdict: the tables' pages link no other
#: host (README), so a host's scores are its own shares of the seeds.
_URLS = r"""WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(h, p, says) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (SELECT page_id, h || p AS rule, says FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) = 1),
judged AS (SELECT parts.page_id, host, path, rule, says FROM parts LEFT JOIN fits ON fits.page_id = parts.page_id),
seeds AS (SELECT says, host, count(*) AS n, sum(count(*)) OVER (PARTITION BY says) AS whole FROM judged WHERE says IS NOT NULL GROUP BY says, host),
hosts AS (SELECT host, coalesce(sum(n / whole) FILTER (says = 'allow'), 0) AS trust, coalesce(sum(n / whole) FILTER (says = 'block'), 0) AS distrust FROM seeds GROUP BY host)
SELECT page_id, judged.host, path, rule, coalesce(says, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict FROM judged LEFT JOIN hosts ON hosts.host = judged.host"""

_REACH = """reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)"""

_NEAR = f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
links AS (SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.label = y.label AND x.id <> y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.93), {_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE links.a = nodes.id) AS n_links, component_id, id = component_id AS kept FROM nodes JOIN least ON least.a = nodes.id"""

_JACCARD = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
sets AS (SELECT doc_id AS id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words),
nodes AS (SELECT id, len(s) AS n FROM sets), held AS (SELECT id, unnest(s) AS shingle FROM sets),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM held x JOIN held y ON x.shingle = y.shingle AND x.id <> y.id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN nodes p ON p.id = a JOIN nodes q ON q.id = b WHERE 100 * c >= 90 * (p.n + q.n - c)), {_REACH}
SELECT id AS doc_id, n AS n_shingles, component_id FROM nodes JOIN least ON least.a = nodes.id"""

#: One round: each part's nearest entry, ties to the lower index, and the floors of the means of those that an entry got.
_NEAREST = """near{k} AS (SELECT row, p, arg_min(e, dist * 64 + e) AS e, min(dist) AS dist FROM (
  SELECT row, p, e, (parts.a - b.a) ** 2 + (parts.b - b.b) ** 2 + (parts.c - b.c) ** 2 + (parts.d - b.d) ** 2 AS dist FROM parts JOIN book{k} b USING (p)) GROUP BY row, p)"""

_MEANS = """mean{k} AS (SELECT p, e, {means} FROM parts JOIN near{k} USING (row, p) GROUP BY p, e),
book{after} AS (SELECT p, e, {entries} FROM book{k} old LEFT JOIN mean{k} new USING (p, e))"""


def _codes_sql() -> str:
    means = ", ".join(f"((sum({c}) - ((sum({c}) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS {c}" for c in "abcd")
    entries = ", ".join(f"coalesce(new.{c}, old.{c}) AS {c}" for c in "abcd")
    rounds = ",\n".join([_NEAREST.format(k=k) + (",\n" + _MEANS.format(k=k, after=k + 1, means=means, entries=entries) if k < 2 else "") for k in range(3)])
    return f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding::DOUBLE[], lambda c: floor(256 * c)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT row, p, x[4 * p + 1] AS a, x[4 * p + 2] AS b, x[4 * p + 3] AS c, x[4 * p + 4] AS d FROM kept, range(16) AS t(p)),
book0 AS (SELECT p, row - 1 AS e, a, b, c, d FROM parts WHERE row <= 64),
{rounds},
coded AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM near2 GROUP BY row),
said AS (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), said"""


#: Base 32 takes five bits a letter: four letters of five hex digits.
_WARC = """WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
facts AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS first FROM payloads)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(hex, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact FROM facts"""

ORACLE_SQL: dict[str, str] = {"op6_url_filters": _URLS, "op8_embedding_neardup": _NEAR, "op10_ngram_jaccard": _JACCARD, "op12_warc": _WARC, "op13_vector_codes": _codes_sql()}
