"""One thin query per corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .collocations import collocations
from .common import read
from .filter_audit import audit
from .html_extract import extract_html
from .learned_partitions import nearest_neighbours
from .line_templates import drop_lines
from .mixing import mix
from .quality_rules import quality
from .simhash import as_hex, near_duplicates
from .spotsigs import fingerprint, fingerprints_and_edits, jaccard
from .substrings import drop_repeats
from .toxicity import THRESHOLD, learn
from .url_filters import filter_urls

#: Verdict, host and path of the rules that op9 applies.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels = read(spark, sf_dir, "labels").where(~held_out)
    scored = learn(docs, labels).score(docs)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_html(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex(F.col("__fp")).alias("fingerprint"), "component_id")


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("__row.doc_id").alias("doc_id"),
        F.col("__lines").alias("n_lines"),
        F.col("__dropped").alias("n_dropped"),
        F.sha2(F.coalesce("__kept", F.lit("")), 256).alias("kept_sha256"),
    )


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_round_trip(docs, path, keep_text=False).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints_and_edits(read(spark, sf_dir, "documents"))
    own, edited, after = F.col("signatures"), F.col("edited_signatures"), F.col("next_signatures")
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"),
        fingerprint(edited).alias("edited_fingerprint"),
        jaccard(own, edited).alias("near_edited"),
        jaccard(own, after).alias("near_next"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH texts AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM texts),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS w FROM starts),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM later),
lists AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM texts),
kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.k) AS kept FROM words w
  LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.k = g.k WHERE g.k IS NULL GROUP BY w.doc_id)
SELECT t.doc_id, len(t.ws)::BIGINT AS n_words, coalesce(len(l.ks), 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM texts t LEFT JOIN lists l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

OP9_SQL = """
WITH rules(verdict, host, path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
urls AS (SELECT page_id, row_number() OVER () AS n,
  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, n,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
fit AS (SELECT p.n, max_by(r.host || r.path, length(r.host) + length(r.path)) AS rule,
  max_by(r.verdict, length(r.host) + length(r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.n)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fit USING (n)
"""

OP11_SQL = """
WITH pieces AS (SELECT lang, unnest(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS t FROM documents)),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists),
grams AS (SELECT lang, ws[i:i + k - 1] AS g, k FROM starts, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, g, k, count(*) AS a FROM grams GROUP BY lang, g, k),
totals AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT lang, g, k, a, unnest(range(1, k)) AS cut FROM candidates),
scored AS (SELECT c.*, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON c.lang = x.lang AND x.g = c.g[1:cut] JOIN f y ON c.lang = y.lang AND y.g = c.g[cut + 1:c.k]),
chosen AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inside AS (SELECT lang, k, a AS longer, unnest([g[1:2], g[2:3]]) AS g FROM candidates WHERE k = 3),
kept AS (SELECT * FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.g = c.g AND 100 * i.longer >= 50 * c.a)),
ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked) JOIN totals USING (lang)
WHERE rank <= 2000
"""

OP12_SQL = """
WITH firsts AS (SELECT coalesce(text, '') AS t, min(doc_id) AS least FROM documents GROUP BY 1),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
texts AS (SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(d.text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents d),
judged AS (SELECT x.part,
  [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * length(regexp_replace(x.t, '[^A-Z]', '', 'g')) > 10 * length(x.t),
   regexp_matches(x.t, '[#$%&*|]'), x.doc_id > f.least] AS fails, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic
  FROM texts x JOIN firsts f USING (t) LEFT JOIN marks m USING (doc_id)),
groups AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS k),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT filter_order, step, ks[step] AS k, ks[1:step - 1] AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
met AS (SELECT g.*, s.filter_order, s.step, s.k, g.fails[s.k] AS here,
  len(list_filter(s.earlier, lambda j: g.fails[j])) > 0 AS before,
  len(list_filter(g.fails, lambda f: f)) = 1 AS single FROM groups g, steps s),
counted AS (SELECT part, filter_order, step, k,
  sum(CASE WHEN NOT here AND NOT before THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN here AND NOT before THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN here AND before THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN here AND single THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN here AND NOT before THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN here AND NOT before THEN toxic ELSE 0 END) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM counted
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_extraction": op3_html_extraction,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_line_templates": op6_line_templates,
    "op7_substrings": op7_substrings,
    "op8_bpe": op8_bpe,
    "op9_url_filters": op9_url_filters,
    "op10_spotsigs": op10_spotsigs,
    "op11_collocations": op11_collocations,
    "op12_filter_audit": op12_filter_audit,
    "op13_neighbours": op13_neighbours,
}

ORACLE_SQL: dict[str, str] = {"op7_substrings": OP7_SQL, "op9_url_filters": OP9_SQL, "op11_collocations": OP11_SQL, "op12_filter_audit": OP12_SQL}
