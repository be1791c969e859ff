"""The registry of queries over the fixture tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import buckets, hashing, legality, scoring, text
from .operators import artifacts, batches, census, fingerprints, manifest, metrics, ranges, sequences, splits, stats, stretches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bucket_sql(value: str, base: str) -> str:
    names = buckets.labels()
    cases = " ".join(f"WHEN {value} <= {b!r} * {base} THEN '{n}'" for b, n in zip(buckets.THRESHOLDS, names[1:]))
    return f"CASE WHEN {value} <= 0 THEN '{names[0]}' {cases} ELSE '{names[-1]}' END"


def _priced(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_extendedprice").alias("price"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("total"), "o_orderpriority")
    return lines.join(orders, "l_orderkey").withColumn("bucket", buckets.range_bucket(F.col("price"), F.col("total")))


PRICED = f"""priced AS (SELECT l_orderkey, l_returnflag, o_orderpriority, l_extendedprice AS price, o_totalprice AS total,
  {_bucket_sql("l_extendedprice", "o_totalprice")} AS bucket FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
INTERVALS = ", ".join(f"('{n}', {a!r}, {b!r}, {m!r})" for n, a, b, m in buckets.intervals() if b is not None)


@query(f"WITH {PRICED} SELECT bucket, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM priced GROUP BY bucket")
def ratio_bucket_histogram(spark, sf_dir):
    return _priced(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"))


@query(f"""WITH {PRICED}, ranked AS (SELECT bucket, price / total AS ratio, row_number() OVER (PARTITION BY bucket ORDER BY price / total) AS k,
  count(*) OVER (PARTITION BY bucket) AS n FROM priced),
medians AS (SELECT bucket, avg(ratio) AS median, any_value(n) AS n FROM ranked WHERE k IN ((n + 1) // 2, n // 2 + 1) GROUP BY bucket),
dim(bucket, lower, upper, middle) AS (VALUES {INTERVALS})
SELECT d.bucket, round(coalesce(m.median, d.middle), 6) AS representative, coalesce(m.n, 0) AS n,
  CASE WHEN m.median IS NULL THEN 'midpoint' ELSE 'median' END AS provenance
FROM dim d LEFT JOIN medians m USING (bucket) WHERE d.upper <= 20""")
def bucket_representatives(spark, sf_dir):
    medians = stats.exact_median(_priced(spark, sf_dir).withColumn("ratio", F.col("price") / F.col("total")), ["bucket"], "ratio")
    dim = spark.createDataFrame(buckets.intervals()[: buckets.OUTPUTS], "bucket string, lower double, upper double, middle double")
    return F.broadcast(dim).join(medians, "bucket", "left").select(
        "bucket",
        F.round(F.coalesce("median", "middle"), 6).alias("representative"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.when(F.col("median").isNull(), "midpoint").otherwise("median").alias("provenance"),
    )


@query("""WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(CASE WHEN k = CAST(round_even((n - 1) * 0.5::DOUBLE, 0) AS BIGINT) + 1 THEN n_chars END) AS median,
  max(CASE WHEN k = CAST(round_even((n - 1) * 0.95::DOUBLE, 0) AS BIGINT) + 1 THEN n_chars END) AS p95,
  max(CASE WHEN k = CAST(round_even((n - 1) * 0.99::DOUBLE, 0) AS BIGINT) + 1 THEN n_chars END) AS p99 FROM r GROUP BY lang""")
def nearest_rank_percentiles(spark, sf_dir):
    return stats.nearest_rank(table(spark, sf_dir, "documents"), ["lang"], "n_chars", {"median": 0.5, "p95": 0.95, "p99": 0.99})


@query("""SELECT lang, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean,
  count(*) FILTER (WHERE n_chars > 5000) AS over_limit FROM documents GROUP BY lang""")
def length_statistics(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"), F.count_if(n > 5000).alias("over_limit")
    )


FRACTION = "(('0x' || substr(sha256('docs' || chr(0) || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE)"


@query(f"""SELECT split, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT n_chars, CASE WHEN {FRACTION} < 0.05 THEN 'test'
  WHEN {FRACTION} < 0.15 THEN 'val' ELSE 'train' END AS split FROM documents) GROUP BY split""")
def stable_split_assign(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("n_chars", hashing.stable_fraction(F.col("doc_id"), "docs").alias("f"))
    split = F.when(F.col("f") < 0.05, "test").when(F.col("f") < 0.15, "val").otherwise("train")
    return docs.groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def _subset_sql(name: str, target: str) -> str:
    """All subsets as numbers whose bits are the groups in order; of the closest sums the smallest number is the path found first."""
    return f"""{name}_sums AS (SELECT m, coalesce(list_sum(list_transform(ns, lambda n, i: CASE WHEN (m >> (i - 1)) & 1 = 1 THEN n ELSE 0 END)), 0) AS s, gs
  FROM (SELECT list(n ORDER BY f, source) AS ns, list(source ORDER BY f, source) AS gs FROM {name}_groups) , LATERAL (SELECT unnest(range(1::BIGINT << len(ns))) AS m)),
{name} AS (SELECT unnest(list_filter(gs, lambda g, i: (m >> (i - 1)) & 1 = 1)) AS source FROM (SELECT * FROM {name}_sums ORDER BY abs(s - ({target})), s, m LIMIT 1))"""


GROUP_FRACTION = "('0x' || substr(sha256('sources-1:{}' || chr(0) || source), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE"


@query(f"""WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source), total AS (SELECT sum(n) AS n FROM counts),
tests_groups AS (SELECT source, n, {GROUP_FRACTION.format("test")} AS f FROM counts), {_subset_sql("tests", "SELECT round_even(n * 0.05::DOUBLE, 0) FROM total")},
vals_groups AS (SELECT source, n, {GROUP_FRACTION.format("val")} AS f FROM counts WHERE source NOT IN (SELECT source FROM tests)), {_subset_sql("vals", "SELECT round_even(n * 0.1::DOUBLE, 0) FROM total")}
SELECT split, sum(n)::BIGINT AS n, count(*) AS sources FROM (SELECT n, CASE WHEN source IN (SELECT source FROM tests) THEN 'test' WHEN source IN (SELECT source FROM vals) THEN 'val' ELSE 'train' END AS split FROM counts) GROUP BY split""")
def group_split_closest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    found = splits.split_groups(docs, "source", "sources-1")
    return found.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query(f"""WITH s AS (SELECT md5(text) AS k, CASE WHEN {FRACTION} < 0.05 THEN 'test' WHEN {FRACTION} < 0.15 THEN 'val' ELSE 'train' END AS split FROM documents),
d AS (SELECT DISTINCT k, split FROM s)
SELECT a.split AS one, b.split AS two, count(*) AS shared FROM d a JOIN d b ON a.k = b.k AND a.split < b.split GROUP BY ALL""")
def split_leakage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("k"), hashing.stable_fraction(F.col("doc_id"), "docs").alias("f"))
    split = F.when(F.col("f") < 0.05, "test").when(F.col("f") < 0.15, "val").otherwise("train")
    return splits.leakage(docs.withColumn("split", split), "k")


@query("""SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM (SELECT CASE WHEN NOT coalesce(n_chars > 0, false) THEN 'empty'
  WHEN NOT coalesce(lang IN ('en', 'de', 'fr'), false) THEN 'language' WHEN NOT coalesce(source NOT IN ('src3', 'src7'), false) THEN 'source'
  WHEN NOT coalesce(n_chars <= 4000, false) THEN 'size' END AS reason FROM documents) GROUP BY 1""")
def rejection_cascade(spark, sf_dir):
    checks = [
        ("empty", F.col("n_chars") > 0),
        ("language", F.col("lang").isin("en", "de", "fr")),
        ("source", ~F.col("source").isin("src3", "src7")),
        ("size", F.col("n_chars") <= 4000),
    ]
    reason = F.coalesce(text.cascade(checks), F.lit("accepted"))
    return table(spark, sf_dir, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, nullif(regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1), '') AS lang, CASE WHEN regexp_extract(html, '<h1>([^<]*)', 1) = '' THEN NULL ELSE trim(regexp_extract(html, '<h1>([^<]*)', 1)) END AS title,
  CASE WHEN len(string_split(p, '/')) > 1 THEN string_split(p, '/')[1] ELSE 'root' END AS folder
FROM (SELECT *, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS p FROM pages)""")
def header_fields(spark, sf_dir):
    # a page's attributes as the lines of a header
    header = F.concat(F.lit("lang = "), F.regexp_extract("html", '<html[^>]*lang="([^"]*)"', 1), F.lit("\ntitle = "), F.regexp_extract("html", "<h1>([^<]*)", 1), F.lit("\n"))
    path = F.regexp_replace("url", r"^[a-z]+://[^/]*/?", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.header_field(header, "lang").alias("lang"), text.header_field(header, "title").alias("title"), manifest.source_folder(path).alias("folder")
    )


@query("""SELECT CASE WHEN grouping(event_type) = 0 THEN 'type' WHEN grouping(bucket) = 0 THEN 'bucket' ELSE 'all' END AS dimension,
  coalesce(event_type, bucket::VARCHAR, '') AS key, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT event_type, user_id % 10 AS bucket, value FROM events) GROUP BY GROUPING SETS ((event_type), (bucket), ())""")
def grouped_counter_rollup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("bucket"), "value")
    sets = events.groupingSets([["event_type"], ["bucket"], []], "event_type", "bucket")
    found = sets.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.grouping("event_type").alias("gt"), F.grouping("bucket").alias("gb"))
    name = F.when(F.col("gt") == 0, "type").when(F.col("gb") == 0, "bucket").otherwise("all")
    return found.select(name.alias("dimension"), F.coalesce("event_type", F.col("bucket").cast("string"), F.lit("")).alias("key"), "n", "total")


@query("""WITH seen AS (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0),
first AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1)
SELECT event_id, user_id, event_type FROM first f WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = f.user_id)""")
def resume_anti_dedup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    done = events.where("user_id % 3 = 0").select("user_id").distinct()
    first = sequences.keep_first(events.join(done, "user_id", "left_anti"), ["user_id", "event_type"], ["ts", "event_id"])
    return first.select("event_id", "user_id", "event_type")


@query("""WITH w AS (SELECT role, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) AS word FROM conversations),
c AS (SELECT word, count(*) AS total, count(*) FILTER (WHERE role = 'assistant') AS supervised FROM w GROUP BY word),
vocab(word) AS (VALUES ('the'), ('of'), ('and'), ('zebra'), ('in'))
SELECT v.word, coalesce(total, 0) AS total, coalesce(supervised, 0) AS supervised, coalesce(total - supervised, 0) AS context FROM vocab v LEFT JOIN c USING (word)""")
def token_frequency_masked(spark, sf_dir):
    vocabulary = spark.createDataFrame([("the",), ("of",), ("and",), ("zebra",), ("in",)], "word string")
    words = table(spark, sf_dir, "conversations").select("role", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''")
    words = words.join(F.broadcast(vocabulary), "word", "left_semi")
    n = words.groupBy("word").agg(F.count("*").alias("total"), F.count_if(F.col("role") == "assistant").alias("supervised"))
    zero = F.lit(0).cast("long")
    return F.broadcast(vocabulary).join(n, "word", "left").select(
        "word", F.coalesce("total", zero).alias("total"), F.coalesce("supervised", zero).alias("supervised"), F.coalesce(F.col("total") - F.col("supervised"), zero).alias("context")
    )


@query("""WITH t AS (SELECT conv_id, string_agg(role, ' ' ORDER BY turn, role, text) AS path, count(*) AS length, conv_id % 4 AS shard FROM conversations GROUP BY conv_id)
SELECT conv_id, path, length, coalesce(sum(length) OVER (PARTITION BY shard ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t""")
def trajectory_build(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    built = sequences.build(turns, "conv_id", ["turn", "role", "text"], F.col("role")).withColumn("shard", F.col("conv_id") % 4)
    placed = sequences.running_offset(built, "shard", "conv_id", "length", "start")
    return placed.select("conv_id", F.array_join("items", " ").alias("path"), F.col("length").cast("long").alias("length"), F.col("start").cast("long").alias("start"))


@query("""WITH t AS (SELECT conv_id, list(length(text) ORDER BY turn, role, text) AS xs, list((role = 'assistant')::INT ORDER BY turn, role, text) AS ms FROM conversations GROUP BY conv_id),
b AS (SELECT *, len(xs) - 1 AS n, max(len(xs) - 1) OVER (PARTITION BY conv_id // 8) AS width FROM t WHERE len(xs) > 1),
p AS (SELECT conv_id, unnest(range(1, width + 1)) AS i, xs, ms, n FROM b)
SELECT conv_id, i, CASE WHEN i <= n THEN xs[i] ELSE 99 END AS input, CASE WHEN i <= n THEN xs[i + 1] ELSE -1 END AS target, CASE WHEN i <= n THEN ms[i + 1] ELSE 0 END AS mask FROM p""")
def shift_and_pad(spark, sf_dir):
    item = F.struct(F.length("text").alias("x"), (F.col("role") == "assistant").cast("int").alias("m"))
    built = sequences.build(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], item).where("length > 1")
    shifted = built.select("conv_id", sequences.shift(F.col("items.x"), F.col("items.m")).alias("s")).withColumn("batch", F.floor(F.col("conv_id") / 8))
    width = F.max(F.size("s.inputs")).over(Window.partitionBy("batch"))
    padded = shifted.withColumn("width", width).select("conv_id", F.posexplode(F.arrays_zip(
        sequences.pad(F.col("s.inputs"), F.col("width"), 99).alias("input"), sequences.pad(F.col("s.targets"), F.col("width"), -1).alias("target"), sequences.pad(F.col("s.mask"), F.col("width"), 0).alias("mask"))).alias("i", "z"))
    return padded.select("conv_id", (F.col("i") + 1).cast("long").alias("i"), F.col("z.input").cast("long").alias("input"), F.col("z.target").cast("long").alias("target"), F.col("z.mask").alias("mask"))


@query("""WITH s AS (SELECT conv_id, role, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS span FROM conversations)
SELECT conv_id, span::BIGINT AS span, count(*) FILTER (WHERE role = 'assistant') AS answers FROM s WHERE span > 0 GROUP BY conv_id, span HAVING count(*) FILTER (WHERE role = 'assistant') <> 1""")
def one_target_per_span(spark, sf_dir):
    found = sequences.spans(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], F.col("role") == "user").where("span > 0")
    return found.groupBy("conv_id", "span").agg(F.count_if(F.col("role") == "assistant").alias("answers")).where("answers <> 1")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_type, round(value)::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f(user_id, k, pot, bet, raises) AS (
  SELECT user_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL
  SELECT o.user_id, o.k, CASE WHEN event_type = 'signup' THEN v ELSE pot + v END, CASE WHEN event_type = 'signup' THEN v ELSE greatest(bet, v) END,
    CASE WHEN event_type = 'signup' THEN 0 WHEN v > bet THEN raises + 1 ELSE raises END
  FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, max(k) AS events, arg_max(pot, k) AS pot, arg_max(bet, k) AS bet, arg_max(raises, k) AS raises FROM f GROUP BY user_id""")
def event_replay_fold(spark, sf_dir):
    item = F.struct(F.col("event_type").alias("kind"), F.round("value").cast("long").alias("v"))
    zero = F.lit(0).cast("long")
    built = sequences.build(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], item)

    def step(a, x):
        reset = x["kind"] == "signup"
        raised = a["raises"] + (x["v"] > a["bet"]).cast("long")
        return F.struct(F.when(reset, x["v"]).otherwise(a["pot"] + x["v"]).alias("pot"), F.when(reset, x["v"]).otherwise(F.greatest(a["bet"], x["v"])).alias("bet"), F.when(reset, zero).otherwise(raised).alias("raises"))

    state = F.aggregate("items", F.struct(zero.alias("pot"), zero.alias("bet"), zero.alias("raises")), step)
    return built.select("user_id", F.col("length").cast("long").alias("events"), state.alias("s")).select("user_id", "events", "s.*")


STATE = """state AS (SELECT o_orderkey, o_totalprice AS pot, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE round(o_totalprice / 10, 2) END AS to_call,
  round(o_totalprice / (1 + o_orderkey % 7), 2) AS stack, o_orderkey % 2 = 0 AS reopened,
  CASE o_orderkey % 5 WHEN 0 THEN 'FOLD' WHEN 1 THEN 'CALL' WHEN 2 THEN 'CHECK' WHEN 3 THEN 'BET' ELSE 'RAISE' END AS action FROM orders)"""


@query(f"""WITH {STATE}, sized AS (SELECT *, 1000.0::DOUBLE AS min_bet, CASE WHEN action = 'BET' THEN 1500.0 ELSE to_call + 900.0 END AS size,
  CASE WHEN action = 'BET' THEN 1000.0 ELSE to_call + 1000.0 END AS least,
  CASE WHEN stack <= 0 THEN [] ELSE list_filter([CASE WHEN to_call > 0 THEN 'FOLD' END, CASE WHEN to_call > 0 THEN 'CALL' ELSE 'CHECK' END,
    CASE WHEN to_call = 0 THEN 'BET' WHEN reopened AND stack > to_call THEN 'RAISE' END], lambda x: x IS NOT NULL) END AS allowed FROM state),
judged AS (SELECT action, CASE WHEN NOT list_contains(allowed, action) THEN 'action not available' WHEN action NOT IN ('BET', 'RAISE') THEN NULL
  WHEN size <= 0 THEN 'not positive' WHEN size > stack THEN 'beyond the stack' WHEN size < least AND size < stack THEN 'below the minimum'
  WHEN action = 'RAISE' AND size <= to_call THEN 'not above the call' END AS reason FROM sized)
SELECT action, coalesce(reason, 'legal') AS reason, count(*) AS n FROM judged GROUP BY ALL""")
def legality_check(spark, sf_dir):
    k, total = F.col("o_orderkey"), F.col("o_totalprice")
    action = F.when(k % 5 == 0, "FOLD").when(k % 5 == 1, "CALL").when(k % 5 == 2, "CHECK").when(k % 5 == 3, "BET").otherwise("RAISE")
    state = table(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, 0.0).otherwise(F.round(total / 10, 2)).alias("to_call"), F.round(total / (1 + k % 7), 2).alias("stack"), (k % 2 == 0).alias("reopened"), action.alias("action")
    )
    size = F.when(F.col("action") == "BET", 1500.0).otherwise(F.col("to_call") + 900.0)
    reason = legality.check_action(F.col("action"), size, F.col("to_call"), F.col("to_call"), F.col("stack"), F.lit(1000.0), F.lit(1000.0), F.col("reopened"))
    return state.groupBy("action", F.coalesce(reason, F.lit("legal")).alias("reason")).agg(F.count("*").alias("n"))


def _scored(spark, sf_dir):
    """Embeddings as predictions: ten logits, their probabilities and the likeliest label."""
    logits = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", scoring.softmax(logits).alias("p")).withColumn("predicted", scoring.argmax(F.col("p")))


SCORED = """logits AS (SELECT vec_id, label, unnest(range(10))::INT AS i, unnest(embedding[1:10])::DOUBLE * 10 AS x FROM embeddings),
powers AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM logits),
probs AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS k FROM powers),
scored AS (SELECT vec_id, any_value(label) AS label, max(CASE WHEN k = 1 THEN i END) AS predicted, max(p) AS top,
  max(CASE WHEN i = label THEN p END) AS truth_p, max(CASE WHEN i = label THEN k END) AS truth_rank FROM probs GROUP BY vec_id)"""


@query(f"""WITH {SCORED} SELECT vec_id, predicted, round(top, 6) AS top, round(truth_p, 6) AS truth_p, truth_rank <= 3 AS in_top3,
  CASE WHEN predicted < 3 THEN 'A' WHEN predicted < 6 THEN 'B' ELSE 'C' END AS family FROM scored""")
def subset_softmax_topk(spark, sf_dir):
    family = F.when(F.col("predicted") < 3, "A").when(F.col("predicted") < 6, "B").otherwise("C")
    return _scored(spark, sf_dir).select(
        "vec_id", "predicted", F.round(F.array_max("p"), 6).alias("top"), F.round(F.get("p", F.col("label")), 6).alias("truth_p"),
        F.array_contains(scoring.top_k(F.col("p"), 3), F.col("label")).alias("in_top3"), family.alias("family"),
    )


@query(f"""WITH {SCORED}, g AS (SELECT vec_id, CASE WHEN i < 3 THEN 0 WHEN i < 6 THEN 1 ELSE 2 END AS grp, sum(p) AS s FROM probs GROUP BY ALL),
best AS (SELECT vec_id, arg_max(grp, s) AS grp, max(s) AS s FROM g GROUP BY vec_id),
pick AS (SELECT b.vec_id, b.grp, b.s, p.i, row_number() OVER (PARTITION BY b.vec_id ORDER BY p.p DESC, p.i) AS k FROM best b JOIN probs p ON p.vec_id = b.vec_id
  AND CASE WHEN p.i < 3 THEN 0 WHEN p.i < 6 THEN 1 ELSE 2 END = b.grp)
SELECT vec_id, grp, round(s, 6) AS share, i AS choice FROM pick WHERE k = 1""")
def grouped_greedy(spark, sf_dir):
    groups = [[0, 1, 2], [3, 4, 5], [6, 7, 8, 9]]
    found = _scored(spark, sf_dir).withColumn("sums", scoring.group_sums(F.col("p"), groups)).withColumn("grp", scoring.argmax(F.col("sums")))
    inside = F.array(*[F.array(*[F.lit(i) for i in g]) for g in groups])
    of = F.get(inside, F.col("grp"))
    best = F.array_max(F.transform(of, lambda i: F.struct(F.get("p", i).alias("p"), (-i).alias("i"))))
    return found.select("vec_id", "grp", F.round(F.array_max("sums"), 6).alias("share"), (-best["i"]).alias("choice"))


@query(f"""WITH {SCORED}, l AS (SELECT unnest(range(10))::INT AS label) SELECT a.label AS truth, b.label AS predicted, count(s.vec_id) AS n
FROM l a CROSS JOIN l b LEFT JOIN scored s ON s.label = a.label AND s.predicted = b.label GROUP BY ALL""")
def confusion_dense(spark, sf_dir):
    labels = spark.range(10).select(F.col("id").cast("int").alias("label"))
    return metrics.confusion(_scored(spark, sf_dir).withColumnRenamed("label", "truth"), "truth", "predicted", labels)


@query("SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL")
def binary_confusion(spark, sf_dir):
    labels = spark.range(2).select(F.col("id").cast("int").alias("label"))
    return metrics.confusion(table(spark, sf_dir, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("predicted")), "truth", "predicted", labels)


@query(f"""WITH {SCORED} SELECT coalesce(label % 2, -1) AS slice, count(*) AS n, count(*) FILTER (WHERE label = predicted) AS correct,
  round(avg(-ln(greatest(truth_p, 1e-45))), 6) AS loss, round(count(*) FILTER (WHERE label = predicted AND label < 5) / nullif(count(*) FILTER (WHERE label < 5), 0), 6) AS low_accuracy
FROM scored GROUP BY GROUPING SETS ((label % 2), ())""")
def grouped_metrics(spark, sf_dir):
    right = F.col("label") == F.col("predicted")
    rows = _scored(spark, sf_dir).withColumn("slice", F.col("label") % 2)
    found = rows.groupingSets([["slice"], []], "slice").agg(
        F.count("*").alias("n"), F.count_if(right).alias("correct"), F.round(F.avg(scoring.floored_loss(F.get("p", F.col("label")))), 6).alias("loss"), F.round(metrics.rate(right, F.col("label") < 5), 6).alias("low_accuracy")
    )
    return found.withColumn("slice", F.coalesce("slice", F.lit(-1)))


BINS = "bins AS (SELECT CASE WHEN top < 0.5 THEN 0.0::DOUBLE ELSE least(0.9::DOUBLE, floor(top * 10) / 10) END AS bin, count(*) AS n, avg((label = predicted)::INT) AS accuracy, avg(top) AS confidence FROM scored GROUP BY 1)"


@query(f"WITH {SCORED}, {BINS} SELECT bin, n, round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence FROM bins")
def calibration_bins(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(F.array_max("p").alias("top"), (F.col("label") == F.col("predicted")).alias("right"))
    return metrics.calibration(rows, "top", "right").select("bin", "n", F.round("accuracy", 6).alias("accuracy"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH {SCORED}, {BINS} SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM bins")
def calibration_ece(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(F.array_max("p").alias("top"), (F.col("label") == F.col("predicted")).alias("right"))
    return metrics.expected_calibration_error(metrics.calibration(rows, "top", "right")).select(F.round("ece", 6).alias("ece"), "n")


def _flagged(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", (F.col("value") > 20).alias("ok"))


@query("""WITH r AS (SELECT user_id, value > 20 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value > 20 ORDER BY ts, event_id) AS g FROM events),
n AS (SELECT user_id, ok, g, count(*) AS n FROM r GROUP BY ALL) SELECT user_id, ok, max(n) AS longest FROM n GROUP BY ALL""")
def streaks(spark, sf_dir):
    return sequences.streaks(_flagged(spark, sf_dir), "user_id", ["ts", "event_id"], "ok")


@query("""WITH r AS (SELECT user_id, sum((value > 20)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, min(s)::BIGINT AS least, max(s)::BIGINT AS most FROM r WHERE k >= least(20, n) GROUP BY user_id""")
def rolling_minmax(spark, sf_dir):
    rows = sequences.rolling(_flagged(spark, sf_dir).withColumn("n", F.col("ok").cast("long")), "user_id", ["ts", "event_id"], "n", 20)
    return rows.where("rolled is not null").groupBy("user_id").agg(F.min("rolled").alias("least"), F.max("rolled").alias("most"))


@query("""WITH r AS (SELECT row_number() OVER w AS ordinal, value > 20 AS ok, min((value > 20)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT ordinal, count(*) AS n, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE so_far = 1) AS all_correct FROM r GROUP BY ordinal""")
def prefix_all_correct(spark, sf_dir):
    rows = sequences.prefix_all(_flagged(spark, sf_dir), "user_id", ["ts", "event_id"], "ok")
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    return rows.groupBy("ordinal").agg(F.count("*").alias("n"), F.count_if("ok").alias("correct"), F.count_if("all_so_far").alias("all_correct"))


#: One order of all events, which no key cuts.
GLOBAL_SQL = "r AS (SELECT event_id, event_type, value, value > 20 AS ok, row_number() OVER (ORDER BY event_id) AS k FROM events)"


@query(f"""WITH {GLOBAL_SQL}, g AS (SELECT ok, k - row_number() OVER (PARTITION BY ok ORDER BY event_id) AS run FROM r),
n AS (SELECT ok, run, count(*) AS n FROM g GROUP BY ALL) SELECT ok, max(n) AS longest FROM n GROUP BY ok""")
def global_streaks(spark, sf_dir):
    return stretches.streaks(_flagged(spark, sf_dir), [], ["event_id"], "ok")


@query(f"""WITH {GLOBAL_SQL}, s AS (SELECT *, sum(ok::INT) OVER (ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS s, count(*) OVER () AS n FROM r)
SELECT event_type, min(s)::BIGINT AS least, max(s)::BIGINT AS most, count(*) AS windows FROM s WHERE k >= least(100, n) GROUP BY event_type""")
def global_rolling(spark, sf_dir):
    rows = stretches.rolling(_flagged(spark, sf_dir).withColumn("n", F.col("ok").cast("long")), [], ["event_id"], "n", 100)
    return rows.where("rolled is not null").groupBy("event_type").agg(F.min("rolled").alias("least"), F.max("rolled").alias("most"), F.count("*").alias("windows"))


@query(f"""WITH {GLOBAL_SQL}, s AS (SELECT *, min((value >= 0 AND k <= 700)::INT) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS so_far FROM r)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE so_far = 1) AS before_first FROM s GROUP BY event_type""")
def global_prefix_all(spark, sf_dir):
    rows = stretches.ranked(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), [], ["event_id"], "k")
    rows = stretches.prefix_all(rows.withColumn("fine", (F.col("value") >= 0) & (F.col("k") <= 700)), [], ["event_id"], "fine")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("all_so_far").alias("before_first"))


@query("""WITH u AS (SELECT user_id, user_id % 3 AS cohort, bool_or(event_type = 'purchase') AS bought, bool_or(event_type = 'signup') AS signed, count(*) AS n FROM events GROUP BY user_id)
SELECT cohort, count(*) AS users, sum(n)::BIGINT AS events, count(*) FILTER (WHERE bought) AS buyers, round(count(*) FILTER (WHERE bought AND signed) / nullif(count(*) FILTER (WHERE signed), 0), 6) AS rate FROM u GROUP BY cohort""")
def cohort_rates(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.bool_or(F.col("event_type") == "purchase").alias("bought"), F.bool_or(F.col("event_type") == "signup").alias("signed"), F.count("*").alias("n")
    )
    return users.groupBy((F.col("user_id") % 3).alias("cohort")).agg(
        F.count("*").alias("users"), F.sum("n").alias("events"), F.count_if("bought").alias("buyers"), F.round(metrics.rate(F.col("bought"), F.col("signed")), 6).alias("rate")
    )


@query("SELECT count(*) AS sequences, count(*) FILTER (WHERE a) AS perfect, count(*) FILTER (WHERE o) AS any_right FROM (SELECT user_id, bool_and(value > 1) AS a, bool_or(value > 20) AS o FROM events GROUP BY user_id)")
def perfect_sequence_rate(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_and(F.col("value") > 1).alias("a"), F.bool_or(F.col("value") > 20).alias("o"))
    return users.agg(F.count("*").alias("sequences"), F.count_if("a").alias("perfect"), F.count_if("o").alias("any_right"))


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY CAST(ts AS DATE)), 6) AS share FROM events GROUP BY CAST(ts AS DATE), event_type")
def behaviour_shares(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    return metrics.shares(rows, ["day"], "event_type").withColumn("share", F.round("share", 6))


@query("SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id ORDER BY turns DESC, chars DESC, conv_id LIMIT 10")
def longest_topk(spark, sf_dir):
    found = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    return sequences.longest(found, [F.desc("turns"), F.desc("chars"), F.col("conv_id")], 10)


@query("SELECT count(*) AS candidates, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text)) AS known FROM benchmark b")
def novelty_exact(spark, sf_dir):
    found = sequences.exact_matches(table(spark, sf_dir, "benchmark").select("text"), table(spark, sf_dir, "documents"), "text")
    return found.agg(F.count("*").alias("candidates"), F.count_if("known").alias("known"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
k AS (SELECT unnest([1, 2, 3, 5]) AS k), p AS (SELECT k, doc_id, array_to_string(ws[1:k], ' ') AS prefix FROM w CROSS JOIN k WHERE len(ws) >= k),
c AS (SELECT k, prefix, count(*) AS n FROM p GROUP BY ALL)
SELECT doc_id, k, n FROM p JOIN c USING (k, prefix) WHERE n > 1""".replace("\\\\", "\\"))
def novelty_prefix(spark, sf_dir):
    # no more of a text is split than the longest prefix needs
    words = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+", 6)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.slice(F.array_remove(words, ""), 1, 5).alias("items"))
    return sequences.shared_prefixes(rows, "doc_id", "items", (1, 2, 3, 5)).where("n > 1")


@query("SELECT o_orderkey, round(o_totalprice / min(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS scaled FROM orders")
def min_scaled_amounts(spark, sf_dir):
    least = F.min("o_totalprice").over(Window.partitionBy("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / least, 6).alias("scaled"))


@query(f"""WITH {PRICED}, dim(bucket, lower, upper, middle) AS (VALUES {INTERVALS}),
m AS (SELECT l_returnflag, price / total AS ratio, lower, upper FROM priced CROSS JOIN (SELECT * FROM dim WHERE bucket = '0.25_TO_0.5'))
SELECT l_returnflag, count(*) AS n, round(avg(CASE WHEN ratio <= lower THEN lower - ratio WHEN ratio > upper THEN ratio - upper ELSE 0 END), 6) AS distance FROM m GROUP BY l_returnflag""")
def interval_distance(spark, sf_dir):
    _, lower, upper, _ = next(x for x in buckets.intervals() if x[0] == "0.25_TO_0.5")
    distance = buckets.interval_distance(F.lit(lower), F.lit(upper), F.col("price") / F.col("total"))
    return _priced(spark, sf_dir).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(distance), 6).alias("distance"))


MARKERS = [("License", "license"), ("All rights reserved", "rights"), ("@", "contact"), ("TOKEN", "secret"), (" | ", "table")]


@query("SELECT kind, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN contains(text, '{a}') THEN '{b}'" for a, b in MARKERS) + " ELSE 'plain' END AS kind FROM documents) GROUP BY kind")
def error_categories(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(text.first_match(F.col("text"), MARKERS, "plain").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS first, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id")
def first_action(spark, sf_dir):
    return sequences.first_and_last(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


CHECKS = [
    ("quantity_positive", "lineitem", "l_quantity <= 0", "l_orderkey"),
    ("discount_range", "lineitem", "l_discount < 0 OR l_discount > 0.05", "l_orderkey"),
    ("price_positive", "orders", "o_totalprice <= 0", "o_orderkey"),
    ("known_status", "orders", "o_orderstatus NOT IN ('O', 'F')", "o_orderkey"),
]


@query(" UNION ALL ".join(f"SELECT '{c}' AS violated, count(*) AS n, min({k}) AS example FROM {t} WHERE {w}" for c, t, w, k in CHECKS))
def violations(spark, sf_dir):
    # all checks of a table in one pass
    out = None
    for name in dict.fromkeys(t for _, t, _, _ in CHECKS):
        found = F.flatten(F.array(*[F.when(F.expr(w), F.array(F.struct(F.lit(c).alias("violated"), F.col(k).alias("key")))).otherwise(F.array().cast("array<struct<violated:string,key:bigint>>")) for c, t, w, k in CHECKS if t == name]))
        rows = table(spark, sf_dir, name).select(F.inline(found)).groupBy("violated").agg(F.count("*").alias("n"), F.min("key").alias("example"))
        out = rows if out is None else out.unionByName(rows)
    names = spark.createDataFrame([(c,) for c, *_ in CHECKS], "violated string")
    return F.broadcast(names).join(out, "violated", "left").select("violated", F.coalesce("n", F.lit(0)).alias("n"), "example")


@query("""WITH files AS (SELECT n_name AS name, n_name || chr(0) || n_nationkey AS content FROM nation)
SELECT count(*) AS files, sum(length(content))::BIGINT AS size, sha256(string_agg(name || chr(0) || length(content) || chr(0) || sha256(content) || chr(10), '' ORDER BY name)) AS digest FROM files""")
def file_fingerprint(spark, sf_dir):
    # each nation stands for a file, as binaryFile gives it
    content = F.concat("n_name", F.lit("\0"), F.col("n_nationkey").cast("string")).cast("binary")
    return fingerprints.combined(fingerprints.digests(table(spark, sf_dir, "nation").select(F.concat(F.lit("dir/"), "n_name").alias("path"), content.alias("content"))))


@query("""SELECT unnest([0, 1, 2, 3])::INT AS position, unnest(['all', 'english', 'long', 'shouted']) AS step, unnest([a, b, c, d])::BIGINT AS n FROM (
SELECT count(*) AS a, count(*) FILTER (WHERE lang = 'en') AS b, count(*) FILTER (WHERE lang = 'en' AND n_chars >= 500) AS c,
count(*) FILTER (WHERE lang = 'en' AND n_chars >= 500 AND contains(text, '!')) AS d FROM documents)""")
def funnel_census(spark, sf_dir):
    steps = [("english", F.col("lang") == "en"), ("long", F.col("n_chars") >= 500), ("shouted", F.contains("text", F.lit("!")))]
    return census.funnel(table(spark, sf_dir, "documents"), steps)


@query("""WITH a AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity < 49 OR l_linenumber < 5 GROUP BY ALL)
SELECT l_returnflag, l_linenumber, coalesce(a.n, 0)::BIGINT AS recorded, coalesce(b.n, 0)::BIGINT AS recomputed FROM a FULL JOIN b USING (l_returnflag, l_linenumber) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def frequency_recount(spark, sf_dir):
    lines, by = table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"]
    some = lines.where((F.col("l_quantity") < 49) | (F.col("l_linenumber") < 5))
    return census.recount(*[x.groupBy(*by).agg(F.count("*").alias("n")) for x in (lines, some)], by)


@query("""WITH r AS (SELECT l_returnflag, l_quantity::DECIMAL(12,2) * 1.01 AS v FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY v) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM r)
SELECT l_returnflag, any_value(n) AS n, ((sum(v) / count(*))::DECIMAL(18,5))::VARCHAR AS median FROM k WHERE i IN ((n + 1) // 2, n // 2 + 1) GROUP BY l_returnflag""")
def decimal_median(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity").cast("decimal(12,2)") * F.lit(Decimal("1.01"))).alias("v"))
    return stats.exact_median(rows, ["l_returnflag"], "v", ranges=8).select("l_returnflag", "n", F.col("median").cast("decimal(18,5)").cast("string").alias("median"))


@query("""SELECT o_orderkey, sum(c) OVER (PARTITION BY p ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT o_orderkey, o_orderpriority AS p, 1 + o_custkey % 5 AS c FROM orders) QUALIFY before IS NOT NULL""")
def range_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"), (1 + F.col("o_custkey") % 5).alias("c"))
    found = ranges.range_sums(rows, ["p"], ["o_orderkey"], {"before": F.col("c")}, ranges=16)
    return found.where("before > 0").select("o_orderkey", "before")


@query("""WITH t AS (SELECT conv_id, conv_id % 4 AS shard, count(*) AS length FROM conversations GROUP BY conv_id), s AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY shard ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN conv_id % 9 = 4 THEN 1 ELSE 0 END AS start FROM t),
e AS (SELECT *, coalesce(lag(start + length) OVER (PARTITION BY shard ORDER BY conv_id), 0) AS expected FROM s) SELECT conv_id, start::BIGINT AS start, expected::BIGINT AS expected FROM e WHERE start <> expected OR length < 2""")
def offset_violations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("length")).withColumn("shard", F.col("conv_id") % 4)
    placed = sequences.running_offset(turns, "shard", "conv_id", "length", "start").withColumn("start", F.col("start") + F.when(F.col("conv_id") % 9 == 4, 1).otherwise(0))
    return artifacts.offset_violations(placed, "shard", "conv_id", "start", "length").select("conv_id", "start", "expected")


@query("SELECT value, CASE WHEN a THEN 'only_first' ELSE 'only_second' END AS side FROM (SELECT coalesce(x.v, y.v) AS value, y.v IS NULL AS a FROM (SELECT DISTINCT c_nationkey AS v FROM customer WHERE c_nationkey > 2) x FULL JOIN (SELECT DISTINCT n_nationkey AS v FROM nation WHERE n_nationkey < 22) y ON x.v = y.v WHERE x.v IS NULL OR y.v IS NULL)")
def set_difference(spark, sf_dir):
    one = table(spark, sf_dir, "customer").where("c_nationkey > 2").select(F.col("c_nationkey").alias("v"))
    two = table(spark, sf_dir, "nation").where("n_nationkey < 22").select(F.col("n_nationkey").alias("v"))
    return artifacts.set_difference(one, two, "v")


@query(f"""WITH h AS (SELECT doc_id, n_chars, ('0x' || substr(sha256('b:3' || chr(0) || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS f FROM documents),
p AS (SELECT *, floor(f * 4)::INT AS part, row_number() OVER (PARTITION BY floor(f * 4) ORDER BY f, doc_id) - 1 AS rn FROM h),
b AS (SELECT *, rn // 48 AS pool, row_number() OVER (PARTITION BY part, rn // 48 ORDER BY n_chars, rn) - 1 AS place FROM p)
SELECT doc_id, part || '-' || pool AS pool, part || '-' || pool || '-' || (place // 16) AS batch FROM b""")
def length_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return batches.length_batches(docs, "doc_id", "n_chars", 16, 48, "b", epoch=3, pools=4).select("doc_id", "pool", "batch")


@query(f"""WITH {SCORED}, u AS (SELECT vec_id, ('0x' || substr(sha256('draw' || chr(0) || vec_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM embeddings),
c AS (SELECT p.vec_id, i, sum(p) OVER (PARTITION BY p.vec_id ORDER BY i) AS upto, u FROM probs p JOIN u USING (vec_id)) SELECT vec_id, coalesce(min(CASE WHEN upto > u THEN i END), 9) AS drawn FROM c GROUP BY vec_id""")
def sampled_decisions(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", scoring.sample(F.col("p"), hashing.stable_fraction(F.col("vec_id"), "draw")).alias("drawn"))


@query(f"""WITH {PRICED}, dim(bucket, lower, upper, middle) AS (VALUES {INTERVALS}) SELECT p.bucket, count(*) AS n, count(*) FILTER (WHERE price > lower * total AND price <= upper * total) AS inside, round(sum(lower * total), 2) AS low, round(sum(upper * total), 2) AS high
FROM priced p JOIN dim d USING (bucket) GROUP BY p.bucket""")
def interval_chips(spark, sf_dir):
    rows = _priced(spark, sf_dir).withColumn("b", buckets.chip_bounds(F.col("bucket"), F.col("total"))).where("b.upper is not null")
    return rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.count_if(buckets.contains(F.col("b"), F.col("price"))).alias("inside"), F.round(F.sum("b.lower"), 2).alias("low"), F.round(F.sum("b.upper"), 2).alias("high")
    )
