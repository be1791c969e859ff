"""SpotSigs fingerprints: chains of content words behind common words.

Wherever a common word (an anchor) stands, it and the next ``CHAIN`` content
words make a signature of 32 bits; the set of them is the fingerprint, and the
fingerprint's text spells the set out, so that the likeness of two documents
follows from their fingerprints alone.  Sets are compared by Jaccard
similarity; sets whose lengths or ranges don't allow a common signature are
told apart without looking into them.

``near_classes`` searches near-duplicates among sets of similar length only:
sets are partitioned by length so that two sets over the threshold meet in a
partition, join on their rarest signatures, and are pruned by length before the
sets are compared.  Only DataFrame functions are used.

Defined results: words are runs of letters and digits in lower case; a text
without any anchor takes each of its words as one; a text too short for a chain
has the one signature of all its words; a null or empty text has none, and two
empty sets are alike (1); repeated rows get equal results; an empty table gives
an empty one.  ``fingerprints_and_edits`` and ``near_classes`` return their own
columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, bind, materialize
from .components import connected_components

#: Common words of the corpus languages.
COMMON_WORDS = (
    "the of and to a in is that for on with as was at by be this are it from or an he "
    "der die und den das von zu mit sich des auf ist nicht ein eine als auch dem "
    "de la le et les des en un du une que est pour qui dans au par sur pas plus "
    "el y los se del las por con no su para al lo como"
).split()
#: Content words of a chain, and words in which they must be found.
CHAIN, REACH = 2, 12
THRESHOLD = 0.8
#: Ranges of ids that documents are dealt by: at most so many, of about so many rows if there are enough.
MOST_RANGES, RANGE_ROWS = 16_384, 4096


def spot_signatures(text: Column, anchors: list[str] = COMMON_WORDS, chain: int = CHAIN) -> Column:
    """The sorted set of a text's signatures, longs of 32 bits."""
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    even = F.lit(-2).cast("long")
    # the last bit of a word's hash says whether it is an anchor
    hashed = lambda ws: F.transform(ws, lambda w: F.when(w.isin(*sorted(set(anchors))), F.xxhash64(w).bitwiseOR(F.lit(1))).otherwise(F.xxhash64(w).bitwiseAND(even)))
    is_anchor = lambda x: x.bitwiseAND(F.lit(1)) == 1
    short = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))

    def spots(h: Column, every: bool) -> Column:
        def spot(x: Column, i: Column) -> Column:
            after = F.slice(h, i + 2, REACH)
            content = after if every else F.filter(after, lambda y: ~is_anchor(y))
            found = bind(F.slice(content, 1, chain), lambda c: F.when(F.size(c) == chain, short(F.xxhash64(x, c))))
            return found if every else F.when(is_anchor(x), found)

        return F.array_distinct(F.array_compact(F.transform(h, spot)))

    def of(h: Column) -> Column:
        listed = F.when(F.exists(h, is_anchor), spots(h, False)).otherwise(spots(h, True))
        return bind(listed, lambda s: F.when((F.size(s) == 0) & (F.size(h) > 0), F.array(short(F.xxhash64(h)))).otherwise(F.sort_array(s)))

    return bind(bind(split, hashed), of)


def fingerprint(signatures: Column) -> Column:
    """The set as text: eight hex digits for each signature, in order."""
    return F.array_join(F.transform(signatures, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sorted sets; where one is empty or ends before the other begins, they need no comparison."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    apart = (F.get(a, F.size(a) - 1) < F.get(b, F.lit(0))) | (F.get(b, F.size(b) - 1) < F.get(a, F.lit(0)))
    both = F.size(F.array_intersect(a, b))
    share = F.when(apart, 0.0).otherwise(both / (F.size(a) + F.size(b) - both))
    return F.when(some, share).otherwise((F.size(a) == F.size(b)).cast("double")).cast("double")


def near_pairs(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, likeness), a < b, of distinct sets (id, signatures) over the threshold.

    Equal sets are to be grouped before.  A set joins on its rarest signatures,
    as many as one of them must be in any set over the threshold.
    """
    rows = sets.where(F.size("signatures") > 0)
    exploded = rows.select("id", F.size("signatures").alias("n"), F.explode("signatures").alias("signature"))
    counts = exploded.groupBy("signature").agg(F.count("*").alias("seen"))
    order = Window.partitionBy("id").orderBy("seen", "signature")
    rare = (
        exploded.join(counts, "signature")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1)
        .where("seen > 1")
        .select("id", "n", "signature", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold))).alias("band"))
    )
    # a longer set over the threshold stands in the same band or the next
    shorter = rare.select(F.col("id").alias("a"), F.col("n").alias("na"), "signature", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    longer = rare.select(F.col("id").alias("b"), F.col("n").alias("nb"), "signature", "band")
    met = shorter.join(longer, ["band", "signature"]).where((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    met = met.where(F.col("na") >= threshold * F.col("nb") - 1e-9).select("a", "b").distinct()
    left = rows.select(F.col("id").alias("a"), F.col("signatures").alias("sa"))
    right = rows.select(F.col("id").alias("b"), F.col("signatures").alias("sb"))
    found = met.join(left, "a").join(right, "b").withColumn("likeness", jaccard(F.col("sa"), F.col("sb"))).where(F.col("likeness") >= threshold)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def near_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id, links) of each row: the smallest id of its class, and how many other sets its set is linked with.

    Equal sets are one class and aren't expanded into pairs.
    """
    rows = docs.select(F.col(id).alias("own"), F.coalesce(F.col(id), F.lit(LAST_ID)).cast("long").alias("id"), spot_signatures(F.col(text)).alias("signatures"))
    rows = materialize(rows.withColumn("set", F.xxhash64("signatures")), "signatures")
    each = materialize(rows.groupBy("set").agg(F.min("id").alias("least"), F.first("signatures").alias("signatures")), "sets")
    pairs = materialize(near_pairs(each.select(F.col("set").alias("id"), "signatures"), threshold), "pairs")
    ends = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).groupBy("set").agg(F.count("*").alias("links"))
    groups = connected_components(pairs.select("a", "b")).select(F.col("node").alias("set"), "label")
    named = each.select("set", "least").join(groups, "set", "left").withColumn("label", F.coalesce("label", "set"))
    named = materialize(named.join(ends, "set", "left"), "named")
    least = named.groupBy("label").agg(F.min("least").alias("class_id"))
    known = named.join(least, "label").select("set", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    return rows.join(known, "set").select(F.col("own").alias(id), F.nullif("class_id", F.lit(LAST_ID)).alias("class_id"), "links")


def _ranges(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with ``bucket``, ranges of descending ids of about equal size, and their number.

    Bounds come from quantiles of the ids, at most ``MOST_RANGES`` longs.
    """
    spark = rows.sparkSession
    n = rows.agg(F.count("*")).first()[0]
    ranges = min(MOST_RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGE_ROWS, 1))
    shares = [k / ranges for k in range(1, ranges)]
    bounds = sorted(set(rows.agg(F.percentile_approx("id", shares, max(10_000, 4 * ranges))).first()[0] or []))
    if not bounds:
        return rows.withColumn("bucket", F.lit(0)), 1
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def further(low: Column, step: Column) -> Column:
        at = low + step  # how many bounds are known to lie below the id
        return F.when((at <= len(bounds)) & (F.get("__bounds", at - 1) < F.col("id")), at).otherwise(low)

    below = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), further)
    return rows.withColumn("__bounds", F.lit(bounds)).withColumn("bucket", F.lit(len(bounds)) - below).drop("__bounds"), len(bounds) + 1


def fingerprints_and_edits(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document beside an edit of it, whose last third is replaced by the next document's start.

    (id, text, edited, signatures, edited_signatures, next_signatures); the
    order is that of descending ids, null ones first and rows of one id by a
    hash of their text, and after the last comes the first.  Documents are
    dealt once, by ranges of ids; the first of each range goes to the range
    before, too, where it follows the last.
    """
    rows = docs.select(
        F.col(id).alias("own"),
        F.coalesce(F.col(id), F.lit(LAST_ID)).cast("long").alias("id"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("same"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows, ranges = _ranges(rows)
    firsts = rows.groupBy("bucket").agg(F.max(F.struct("id", "same")).alias("first"))
    around = Window.orderBy("bucket")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row of three numbers for each range, of which there are at most MOST_RANGES
    firsts = materialize(firsts.select("first.id", "first.same", F.coalesce(F.lag("bucket").over(around), F.last("bucket").over(whole)).alias("to")), "firsts")
    guests = rows.join(F.broadcast(firsts), ["id", "same"]).select("own", "id", "same", "text", F.col("to").alias("bucket"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("guest", F.lit(False)).unionByName(guests).repartition("bucket").withColumn("signatures", spot_signatures(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("id"), F.desc("same"))
    met = dealt.withColumn("next", F.lead(F.struct("text", "signatures")).over(order)).where("not guest")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - third), F.left("next.text", third))
    found = met.select(F.col("own").alias(id), "text", edited.alias("edited"), "signatures", F.col("next.signatures").alias("next_signatures"))
    return found.withColumn("edited_signatures", spot_signatures(F.col("edited")))
