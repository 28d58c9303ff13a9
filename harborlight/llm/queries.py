"""Registered queries of the corpus operators, and the SQL they are checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm import (context_tree, exact_dedup, fill_middle, language_id, line_dedup, merkle, mixing, neighbours, pieces, simhash,
                             token_files, toxicity, url_filter)
from harborlight.llm.common import prepare, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(prepare(spark), sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(prepare(spark), sf_dir, "embeddings")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, 20)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return line_dedup.without_repeats(docs).select("doc_id", "text", "lines_total", "lines_removed")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(prepare(spark), sf_dir, "documents"))


# The mixture: three domains of sources, by weight; names without a weight have 1.
WEIGHTS = {
    "domain": {"web": 3, "books": 5, "forum": 2},
    "language": {"en": 4, "de": 3, "fr": 2, "es": 1},
    "source_name": {"src1": 2, "src2": 3, "src10": 2},
}
MIX_SHARE, MIX_EPOCHS = (6, 10), 3


def domain_of(source: str = "source") -> Column:
    """src0 is the web crawl, src1 to src9 are books, all others forums."""
    return F.when(F.col(source) == "src0", "web").when(
        F.rlike(F.col(source), F.lit("^src[1-9]$")), "books").otherwise("forum")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return mixing.mixed(docs, domain_of(), MIX_SHARE, MIX_EPOCHS, WEIGHTS)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(prepare(spark), sf_dir, "pages"), RULES)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    manifest = token_files.write_tokens(
        docs, token_files.token_folder(spark), public_tokenizers.path("word_bpe_49k.json"), end=1)
    return token_files.read_documents(manifest)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(prepare(spark), sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.transformed(table(prepare(spark), sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(prepare(spark), sf_dir, "documents"), merkle.tampered_fold(5))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.language_model(table(prepare(spark), sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_neighbours, op3_line_dedup, op4_exact_dedup, op5_mixing, op6_toxicity, op7_url_filter, op8_sentencepiece,
    op9_token_files, op10_language_id, op11_fill_middle, op12_merkle, op13_language_model)}

# The rule itself: no fingerprints, all stretches of lines as text.
ORACLE_LINES = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d WHERE text IS NOT NULL),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
c AS (SELECT doc_id, pos, line, words, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM w WHERE words > 0),
s AS (SELECT *, e - words AS b FROM c),
spans AS (
  SELECT doc_id, list(line) OVER f AS k, min(pos) OVER f AS p, max(pos) OVER f AS q, sum(words) OVER f AS n FROM s
  WINDOW f AS (PARTITION BY doc_id ORDER BY b RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, list(line) OVER f, min(pos) OVER f, max(pos) OVER f, sum(words) OVER f FROM s
  WINDOW f AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
o AS (SELECT array_to_string(k, chr(10)) AS k, min(row(doc_id, p, q)) AS o FROM spans WHERE n >= 50 GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, q + 1)) AS pos FROM spans
  JOIN o ON array_to_string(spans.k, chr(10)) = o.k
  WHERE n >= 50 AND (doc_id > o.o[1] OR (doc_id = o.o[1] AND p > o.o[3]))),
g AS (SELECT doc_id, list(pos) AS ps FROM gone GROUP BY 1)
SELECT d.doc_id,
  CASE WHEN ps IS NULL THEN text ELSE array_to_string(
    list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(ps, i)), lambda i: ls[i + 1]), chr(10)) END AS text,
  coalesce(len(ls), 0)::BIGINT AS lines_total, coalesce(len(ps), 0)::BIGINT AS lines_removed
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

ORACLE_EXACT = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM t
"""



def _level(depth: int, column: str, path: list[str]) -> str:
    """One level of the tree: deal the parent's budget by weight, up to the room."""
    weights = "CASE " + " ".join(
        f"WHEN {column} = '{k}' THEN {w}" for k, w in WEIGHTS[column].items()) + " ELSE 1 END"
    keys, up = ", ".join(path), path[:-1]
    given = f"(SELECT sum(avail) * {MIX_SHARE[0]} // {MIX_SHARE[1]} FROM leaf)" if not up else "any_value(b.budget)"
    join = "" if not up else f"JOIN b{depth - 1} b USING ({', '.join(up)})"
    group = f"PARTITION BY {', '.join(up)}" if up else ""
    return f"""
n{depth} AS (SELECT {keys}, sum(room)::HUGEINT AS room, {given} AS given, {weights} AS weight, {column} AS name
  FROM leaf {join} GROUP BY {keys}),
f{depth} AS (SELECT *, greatest(given - coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS lft,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
  row_number() OVER o AS i FROM n{depth} WINDOW o AS ({group} ORDER BY room::DOUBLE / weight, name)),
p{depth} AS (SELECT *, min(CASE WHEN room * rest > lft * weight THEN i END) OVER ({group}) AS k FROM f{depth}),
q{depth} AS (SELECT *, max(CASE WHEN i = k THEN lft END) OVER ({group}) AS base_left,
  max(CASE WHEN i = k THEN rest END) OVER ({group}) AS base_rest FROM p{depth}),
r{depth} AS (SELECT *, CASE WHEN i >= k THEN base_left * weight // base_rest ELSE room END AS part FROM q{depth}),
b{depth} AS (SELECT {keys}, part + CASE WHEN i >= k AND i - k + 1 <= base_left - sum(part) FILTER (WHERE i >= k) OVER ({group})
  THEN 1 ELSE 0 END AS budget FROM r{depth}),"""


ORACLE_MIX = rf"""
WITH w AS (SELECT doc_id, CASE WHEN source = 'src0' THEN 'web' WHEN regexp_matches(source, '^src[1-9]$') THEN 'books'
  ELSE 'forum' END AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS source_name,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
leaf AS (SELECT domain, language, source_name, sum(tokens) AS avail, sum(tokens) * {MIX_EPOCHS} AS room FROM w GROUP BY ALL),
{_level(0, "domain", ["domain"])}{_level(1, "language", ["domain", "language"])}{_level(2, "source_name", mixing.LEAF)}
e AS (SELECT w.*, budget, avail, CASE WHEN avail > 0 THEN budget // avail ELSE 0 END AS epoch FROM w
  JOIN b2 USING (domain, language, source_name) JOIN leaf USING (domain, language, source_name)),
s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, language, source_name
  ORDER BY md5('1:' || epoch || ':' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT doc_id, domain, language, source_name, tokens, budget::BIGINT AS budget,
  (epoch + CASE WHEN before < budget - epoch * avail THEN 1 ELSE 0 END)::BIGINT AS copies FROM s
"""


LEVELS = 10  # segments that the check SQL follows; the tables have fewer


def _depth(d: int) -> str:
    """One level of the template trees."""
    ends = "bb = 0 OR bb = ll" if d >= url_filter.DEPTH else "false"
    return f"""
h{d} AS MATERIALIZED (SELECT *, CASE WHEN NOT done THEN segs[{d + 1}] END AS seg FROM t{d}),
k{d} AS MATERIALIZED (SELECT host, t, seg, count(*) AS n, count(bad) AS l, coalesce(sum(bad), 0) AS b FROM h{d}
  WHERE seg IS NOT NULL GROUP BY ALL),
n{d} AS (SELECT host, t, count(*) AS kids, sum(n) AS pages, sum(l) AS ll, sum(b) AS bb,
  sum(CASE WHEN regexp_matches(seg, '[0-9]') THEN n ELSE 0 END) AS digits FROM k{d} GROUP BY ALL),
s{d} AS (SELECT host, t, seg, {ends} AS ends, CASE WHEN {ends} THEN '/**'
    WHEN wild AND differs AND l >= {url_filter.FEW} THEN '/' || seg WHEN wild THEN '/*'
    WHEN differs OR ll = 0 THEN '/' || seg ELSE '/~' END AS step
  FROM (SELECT *, digits * 2 > pages OR (kids >= {url_filter.FEW} AND kids * 2 > pages) AS wild,
    (b * ll::DOUBLE - l * bb::DOUBLE) * (b * ll::DOUBLE - l * bb::DOUBLE) > {url_filter.Z2} * l * bb::DOUBLE * (ll - bb) AS differs
    FROM k{d} JOIN n{d} USING (host, t))),
t{d + 1} AS MATERIALIZED (SELECT h.page_id, h.host, h.path, h.rule, h.ruled, h.bad, h.segs, h.t || coalesce(step, '') AS t,
  h.done OR coalesce(ends, false) AS done
  FROM h{d} h LEFT JOIN s{d} s ON h.host = s.host AND h.t = s.t AND h.seg = s.seg),"""


ORACLE_URLS = rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
    '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, rule, h, p) AS (VALUES {", ".join(
    f"('{v}', '{t}', '{t[:t.index('/')]}', '{t[t.index('/'):]}')" for v, t in RULES)}),
m AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, length(h) DESC, rule) AS i
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
t0 AS (SELECT u.*, rule, verdict AS ruled, CASE verdict WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS bad,
  list_filter(string_split(path, '/'), lambda x: x <> '') AS segs, '' AS t, false AS done FROM u LEFT JOIN m ON u.page_id = m.page_id AND i = 1),
{"".join(_depth(d) for d in range(LEVELS))}
f AS MATERIALIZED (SELECT *, t AS template FROM t{LEVELS}),
own AS (SELECT host, template, count(bad) AS l, count(bad) - coalesce(sum(bad), 0) AS good FROM f GROUP BY ALL),
sh AS (SELECT template, sum(l) AS shape_l, sum(good) AS shape_good FROM own GROUP BY ALL),
e AS (SELECT (coalesce(sum(good), 0) + 1.0::DOUBLE) / (coalesce(sum(l), 0) + 2.0::DOUBLE) AS base FROM own),
pure AS (SELECT host, own.template, (good + 2.0::DOUBLE * ((shape_good + 2.0::DOUBLE * base) / (shape_l + 2.0::DOUBLE)))
  / (l + 2.0::DOUBLE) AS purity FROM own JOIN sh USING (template), e)
SELECT page_id, f.host, path, rule, coalesce(ruled, CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  f.template, purity FROM f JOIN pure ON f.host = pure.host AND f.template = pure.template
"""

ORACLE_FIM = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS s,
  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
h AS (SELECT *, ('0x' || s[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || s[9:16])::BIGINT % (len(u) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || s[17:24])::BIGINT % 100 >= 90
    THEN 'plain' WHEN ('0x' || s[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
  array_to_string(u[greatest(x, y) + 1:], '') AS f FROM h)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN len(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN len(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || f || '<M>' || m
    ELSE '<S>' || f || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
"""


def _leaf(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({x})) || ':' || ({x}), '-')" for x in fields) + ")"


_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""

# Runs are slices of ordered lists; the walk carries each leaf's place up, its siblings, and the tampered fold.
ORACLE_MERKLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('s' || source, '') AS src, {_leaf("text")} AS leaf,
  CASE WHEN {_CRC} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
    ELSE {_leaf("text")} END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
up(src, depth, nodes) AS (
  SELECT src, 0, list(leaf ORDER BY pos) FROM l GROUP BY 1
  UNION ALL
  SELECT src, depth + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], '')))
  FROM up WHERE len(nodes) > 1),
subs AS (SELECT src, depth, nodes[1] AS subroot, row_number() OVER (ORDER BY src) - 1 AS pos FROM up WHERE len(nodes) = 1),
tops(depth, nodes) AS (
  SELECT 0, list(subroot ORDER BY pos) FROM subs
  UNION ALL
  SELECT depth + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], '')))
  FROM tops WHERE len(nodes) > 1),
steps AS (  -- every level with more than one node, numbered through to the root
  SELECT up.src, up.depth, nodes, false AS top FROM up WHERE len(nodes) > 1
  UNION ALL SELECT subs.src, subs.depth + tops.depth, nodes, true FROM tops, subs WHERE len(nodes) > 1),
walk(doc_id, src, leaf, depth, pos, sib, fold) AS (
  SELECT doc_id, src, leaf, 0, pos, '', changed FROM l
  UNION ALL
  SELECT w.doc_id, w.src, w.leaf, w.depth + 1, p // 16,
    sib || array_to_string(list_concat(nodes[p - p % 16 + 1:p], nodes[p + 2:p - p % 16 + 16]), ''),
    sha256(array_to_string(list_concat(nodes[p - p % 16 + 1:p], [fold], nodes[p + 2:p - p % 16 + 16]), ''))
  FROM (SELECT w.*, CASE WHEN w.depth = s.depth THEN s.pos ELSE w.pos END AS p FROM walk w JOIN subs s USING (src)) w
  JOIN steps ON steps.src = w.src AND steps.depth = w.depth),
ends AS (SELECT *, row_number() OVER (PARTITION BY doc_id, src, leaf ORDER BY depth DESC) AS i FROM walk)
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM ends JOIN subs USING (src), (SELECT nodes[1] AS root FROM tops WHERE len(nodes) = 1) WHERE i = 1
"""

ORACLES = {"op11_fill_middle": ORACLE_FIM, "op12_merkle": ORACLE_MERKLE, "op3_line_dedup": ORACLE_LINES, "op4_exact_dedup": ORACLE_EXACT, "op5_mixing": ORACLE_MIX,
           "op7_url_filter": ORACLE_URLS}
