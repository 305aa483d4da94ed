"""Queries of this subpackage, by name, and their SQL where SQL can say the same in reasonable time."""

from __future__ import annotations

from annalist.llm.common import table
from annalist.llm.decontaminate import contaminated
from annalist.llm.disclosure import sanitised
from annalist.llm.lattice_lm import lattice_scores
from annalist.llm.license_scan import licenses
from annalist.llm.ngram_join import jaccard_groups
from annalist.llm.quality_eb import quality
from annalist.llm.raking import mixture
from annalist.llm.risk_rules import quality_rules
from annalist.llm.warc import archived
from annalist.llm.zstd_lang import languages


def op1_lattice_lm(spark, sf_dir):
    return lattice_scores(table(spark, sf_dir, "documents"))


def op2_disclosure(spark, sf_dir):
    return sanitised(table(spark, sf_dir, "documents"), with_text=False)


def op3_ngram_jaccard(spark, sf_dir):
    return jaccard_groups(table(spark, sf_dir, "documents")).drop("n_links")


def op4_quality_eb(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_raking(spark, sf_dir):
    return mixture(table(spark, sf_dir, "documents"))


def op6_warc_merge(spark, sf_dir):
    return archived(table(spark, sf_dir, "pages")).drop("part", "place")


def op7_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).distinct()


def op8_zstd_language(spark, sf_dir):
    return languages(table(spark, sf_dir, "documents"))


def op9_risk_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_license_scan(spark, sf_dir):
    return licenses(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lattice_lm, op2_disclosure, op3_ngram_jaccard, op4_quality_eb, op5_raking, op6_warc_merge, op7_decontaminate, op8_zstd_language, op9_risk_rules, op10_license_scan)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE: dict[str, str] = {
    "op3_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = d.doc_id), d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id)""",
    "op6_warc_merge": r"""
WITH b AS (SELECT page_id, coalesce(html, '') AS payload, regexp_replace(url, '[\x00-\x20]', '%20', 'g') AS uri FROM pages),
f AS (SELECT *, octet_length(encode(payload)) AS n, CASE WHEN octet_length(encode(payload)) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS keeper,
  regexp_replace(regexp_replace(coalesce(uri, ''), '^.*?://', ''), '#.*$', '') AS rest FROM b),
g AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(rest, '/.*$', ''), '^.*@', ''), ':.*$', '')), '^www\.', '') AS host, lower(regexp_replace(rest, '^[^/]*', '')) AS path FROM f)
SELECT page_id, n AS payload_bytes, sha1(payload) AS payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to,
  CASE WHEN coalesce(uri, '') = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path END AS urlkey,
  row_number() OVER (ORDER BY CASE WHEN coalesce(uri, '') = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path END, TIMESTAMP '2020-01-01 00:00:00' + to_seconds(page_id % 1000000000), page_id) - 1 AS rank,
  strftime(TIMESTAMP '2020-01-01 00:00:00' + to_seconds(page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM g""",
}
