"""Mixing sources to target weights by Sainte-Laguë apportionment.

All words of the mix are apportioned to the sources by highest quotients
``target / (2 k + 1)``.  A source is cut into blocks of equal size, a small
share of it, so that its quota in blocks comes near its target however small it
is.  Its words are dealt by a hash of the document into shards, and shards into
groups; its blocks go to its groups, and those of a group to its shards, by
highest quotients again.  A shard takes each of its blocks as often as its
quota allows, and the rest by the smallest seeded hashes.

Highest quotients need no list of quotients: every part first gets its share,
rounded, which is the apportionment of some divisor; the few seats that are
then missing (or too many) go to the next (or come from the last) quotients.
Only as many quotients are looked at as can be among these.  Only DataFrame
functions are used, and what a task holds at once is a range of the sources, a
group of shards or one shard's documents.

Defined results: a null text has size 0; documents of size 0 take nothing; a
null source is a source of its own, after all others; repeated rows count as
documents of their own; of equal quotients the smaller part wins; an empty
table gives an empty mix.  ``mix`` returns its own columns only;
``mixed_documents`` returns those of the documents, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, bind, materialize, running, struct_of, words

WEIGHTS = (5.0, 2.0, 1.0)
#: No document and no source is taken more often than this.
MOST = 3
SEED = 7
#: Words of a block, at most, and blocks that a source and its target have, at least, if they have as many words.
LARGEST_BLOCK, LEAST_BLOCKS = 1024, 256
#: Blocks of a shard, and shards of a group.
SHARD_BLOCKS, GROUP_SHARDS = 1024, 512
#: Up to so many sources, their quotas are sent to all executors.
FEW_SOURCES = 10_000


def size(text: str = "text"):
    return F.size(words(F.col(text))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) to the same with ``target``: weights in the order of
    the sources, null last; what is over ``most`` times a source's size goes to
    the others by weight until none is above."""
    one = F.lit(1)
    order = [F.col("source").isNull(), F.col("source")]
    n = F.pmod(F.col("__n"), F.lit(len(weights)))
    weighed = running(sizes, order, {"__n": one}).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n + 1).cast("int")))
    weighed = weighed.withColumn("cap", most * F.col("source_size").cast("double")).drop("__n")
    # sources fill up in the order of cap / weight; the first that isn't full sets the level of the rest,
    # the highest of theirs, as each of them would lower it
    filled = running(weighed, [F.col("cap") / F.col("weight"), *order], {"__cap": F.col("cap"), "__weight": F.col("weight")})
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    size, weight = (float(x or 0) for x in whole)
    level = (F.lit(size) - F.col("__cap")) / (F.lit(weight) - F.col("__weight"))
    filled = materialize(filled.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight")), "levels")
    rest = filled.where("not full").agg(F.max("level").alias("rest")).first()["rest"]
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.lit(rest).cast("double"))
    return filled.withColumn("target", target).select("source", "source_size", "target")


def _candidates(first: DataFrame, bound: Column | None = None) -> DataFrame:
    """The quotients that may gain (or lose) a seat: of each part the first, or all up to ``bound``."""
    share, seats, more = F.col("__share"), F.col("__first"), F.col("__open") > 0
    k = F.lit(1).cast("long")
    if bound is not None:
        # one more than the bound allows, for the sake of rounding; more can't be among the best
        half = (share / bound - 1) / 2
        reach = F.when(more, half - seats + 2).otherwise(seats - half + 1)
        k = F.explode(F.sequence(k, F.greatest(F.lit(1.0), F.least(F.abs("__open").cast("double"), reach)).cast("long")))
    tries = first.where("__open <> 0").withColumn("__k", k)
    seat = F.when(more, seats + F.col("__k") - 1).otherwise(seats - F.col("__k"))
    tries = tries.withColumn("__seat", seat).where("__seat >= 0").withColumn("__quotient", share / (2 * F.col("__seat") + 1))
    # the best first: the highest to gain, the lowest to lose
    return tries.withColumn("__by", F.when(more, -F.col("__quotient")).otherwise(F.col("__quotient")))


def _bound(worst: Column, found: Column, open_: Column) -> Column:
    """The quotient of the last seat if each part could change one; without bound if there aren't enough parts."""
    return F.when(found >= F.abs(open_), F.greatest(F.abs(worst), F.lit(1e-300))).when(open_ > 0, 1e-300).otherwise(1e300)


def sainte_lague(parts: DataFrame, within: list[str], part: str, share: str, seats: str) -> DataFrame:
    """``parts`` with ``quota``: the ``seats`` of each group of parts, by highest ``share / (2 k + 1)``.

    The shares of a group sum to about its seats; of equal quotients the
    smaller ``part`` wins.  A task ranks the parts of one group, or a range of
    the parts if there is one group only (``within`` is empty).
    """
    first = parts.withColumns({"__share": F.col(share), "__first": F.floor(F.col(share) + 0.5)})
    chosen, more = F.col("__rank") < F.abs("__open"), F.col("__open") > 0
    order = [F.col("__by"), F.when(more, F.col(part)), F.when(~more, F.col(part)).desc()]
    best = [F.max("__by").alias("__worst"), F.count("*").alias("__found")]
    if within:
        group = Window.partitionBy(*within)
        first = first.withColumn("__open", (F.col(seats) - F.sum("__first").over(group)).cast("long"))
        rank = F.row_number().over(group.orderBy(*order)) - 1
        bounds = _candidates(first).withColumn("__rank", rank).where(chosen).groupBy(*within).agg(*best)
        ranked = _candidates(first.join(bounds, within), _bound(F.col("__worst"), F.col("__found"), F.col("__open"))).withColumn("__rank", rank)
    else:
        sums = first.agg(F.max(seats).alias("s"), F.sum("__first").alias("f")).first()
        first = materialize(first.withColumn("__open", F.lit((sums["s"] or 0) - (sums["f"] or 0)).cast("long")), "shares")
        last = running(_candidates(first), order, {"__rank": F.lit(1)}).where(chosen).agg(*best).first()
        bound = _bound(F.lit(last["__worst"]).cast("double"), F.lit(last["__found"]), F.col("__open"))
        ranked = running(_candidates(first, bound), order, {"__rank": F.lit(1)})
    gain = F.sum(F.signum(F.col("__open").cast("double")).cast("long")).alias("__change")
    change = ranked.where(chosen).groupBy(*within, part).agg(gain)
    return first.join(change, [*within, part], "left").select(*parts.columns, (F.col("__first") + F.coalesce("__change", F.lit(0))).alias("quota"))


#: What ``mix`` adds to each row.
PARTS = "array<struct<start: bigint, end: bigint, repeats: bigint>>"


def _sized(docs: DataFrame, id: str, text: str, source: str) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    return docs.withColumns(
        {"__id": F.coalesce(F.col(id), F.lit(LAST_ID)), "__same": F.coalesce(F.xxhash64(text), F.lit(0)), "__key": key, "__source": F.col(source), "__size": size(text)}
    )


def _mixed(rows: DataFrame, sizes: DataFrame, weights, most: int, seed: int) -> DataFrame:
    """``rows`` with source_size, target, times and taken; ``sizes`` has their
    __id, __same, __key, __source and __size."""
    sums = sizes.groupBy("__key").agg(F.first("__source").alias("source"), F.sum("__size").alias("source_size"))
    targets = source_targets(sums, weights, most).withColumn("__key", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
    # the unit of the apportionment between sources is a word, so that none is too small for a seat
    targets = targets.withColumn("seats", F.lit(sizes.agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("n")).first()["n"]))
    block = F.greatest(F.lit(1), F.least(F.lit(LARGEST_BLOCK), F.floor(F.least("source_size", "target") / LEAST_BLOCKS)))
    quotas = sainte_lague(targets, [], "__key", "target", "seats").withColumns(
        {"block": block, "shards": F.greatest(F.lit(1), F.ceil(F.col("source_size") / (block * SHARD_BLOCKS)))}
    )
    quotas = materialize(quotas.select("__key", "source_size", "target", "shards", "block", "quota"), "quotas")
    few = quotas.count() <= FEW_SOURCES

    def sharded(df: DataFrame) -> DataFrame:
        salt = F.pmod(F.xxhash64(F.lit(seed), F.col("__id"), "__same"), F.col("shards"))
        return df.join(F.broadcast(quotas) if few else quotas, "__key").withColumn("__shard", salt)

    shards = (
        sharded(sizes)
        .groupBy("__key", "__shard")
        .agg(F.sum("__size").alias("words"), F.first("source_size").alias("all"), F.first("quota").alias("words_taken"), F.first("block").alias("block"))
        .where("words > 0")
        .withColumns({"blocks": F.ceil(F.col("words") / F.col("block")), "__group": F.floor(F.col("__shard") / GROUP_SHARDS)})
        # a quota in words as one in the shard's own blocks
        .withColumn("share", F.col("words_taken") * F.col("blocks") / F.col("all"))
        .drop("words_taken", "all", "block")
    )
    shards = materialize(shards, "shards")
    groups = shards.groupBy("__key", "__group").agg(F.sum("share").alias("share"))
    source_seats = groups.groupBy("__key").agg(F.round(F.sum("share")).cast("long").alias("seats"))
    groups = sainte_lague(groups.join(source_seats, "__key"), ["__key"], "__group", "share", "seats")
    shards = shards.join(groups.select("__key", "__group", F.col("quota").alias("seats")), ["__key", "__group"])
    shards = sainte_lague(shards, ["__key", "__group"], "__shard", "share", "seats").withColumn("quota", F.least("quota", most * F.col("blocks")))
    each = F.floor(F.col("quota") / F.col("blocks"))
    by_hash = F.sort_array(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
            lambda j: F.struct(F.xxhash64(F.lit(seed), F.col("__key"), F.col("__shard"), j).alias("by"), j.alias("block")),
        )
    )
    chosen = F.slice(by_hash, F.lit(1), (F.col("quota") - each * F.col("blocks")).cast("int"))
    drawn = materialize(
        shards.select("__key", "__shard", "words", "blocks", each.alias("each"), F.transform(chosen, lambda x: x["block"]).alias("chosen")),
        "drawn",
    )
    order = Window.partitionBy("__key", "__shard").orderBy("__id", "__same").rowsBetween(Window.unboundedPreceding, -1)
    placed = sharded(rows).drop("shards", "quota", "block").withColumn("from", F.coalesce(F.sum("__size").over(order), F.lit(0)))
    met = placed.join(drawn, ["__key", "__shard"], "left")

    def edge(j):  # block j of a shard covers its words from here on
        return F.floor(j * F.col("words") / F.col("blocks"))

    first = F.floor(F.col("from") * F.col("blocks") / F.col("words"))
    last = F.floor((F.col("from") + F.col("__size") - 1) * F.col("blocks") / F.col("words"))
    spans = F.transform(
        F.sequence(F.greatest(F.lit(0).cast("long"), first - 1), F.least(F.col("blocks") - 1, last + 1)),
        lambda j: F.struct(
            F.greatest(F.lit(0).cast("long"), edge(j) - F.col("from")).alias("start"),
            F.least(F.col("__size"), edge(j + 1) - F.col("from")).alias("end"),
            (F.col("each") + F.array_contains("chosen", j).cast("long")).alias("repeats"),
        ),
    )
    met = met.withColumn("times", F.when(F.col("__size") > 0, F.filter(spans, lambda x: x["start"] < x["end"])).otherwise(F.array().cast(PARTS)))
    count = F.aggregate("times", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]) * x["repeats"])
    return met.withColumn("taken", count).drop("from", "words", "blocks", "each", "chosen")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken, times) of each row.

    ``times`` lists how often each part of the document is taken: structs of
    its first word, its end and the repeats.
    """
    slim = docs.select(F.col(id), F.col(source), F.col(text))
    sizes = materialize(_sized(slim, id, text, source).drop(text), "sizes")
    return _mixed(sizes, sizes, weights, most, seed).select(
        F.col(id), F.col(source), F.col("__size").alias("size"), "source_size", "target", "taken", "times"
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as documents: a row for each repeat, with the words it takes.

    The k-th repeat of a document holds its parts that are taken k times or
    more, each word with the white space before it; where that is all of it,
    the text stays as it is.  ``n_chars`` follows the text.  Documents without
    words count for no quota and stay as they are, once.
    """
    names = docs.columns
    renamed = docs.select(struct_of(docs).alias("__row"), *[F.col(c).alias(a) for c, a in ((id, "__i"), (text, "__t"), (source, "__s"))])
    whole_rows = _sized(renamed, "__i", "__t", "__s")
    sizes = materialize(whole_rows.drop("__row", "__t"), "sizes")
    found = _mixed(whole_rows.drop("__t"), sizes, weights, most, seed)
    repeats = F.coalesce(F.array_max(F.transform("times", lambda x: x["repeats"])), F.lit(1))
    found = found.where("taken > 0 or __size = 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), repeats)))
    old = F.col("__row")[text]
    parts = F.filter("times", lambda x: x["repeats"] >= F.col("__copy"))
    pieces = bind(
        F.regexp_extract_all(old, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0),
        lambda ws: F.array_join(
            F.flatten(F.transform(parts, lambda x: F.slice(ws, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))), ""
        ),
    )
    new = F.when(F.forall("times", lambda x: x["repeats"] >= F.col("__copy")), old).otherwise(pieces)
    found = found.withColumn("__new", new)
    values = {text: F.col("__new")}
    if "n_chars" in names:
        same = F.col("__new").eqNullSafe(old)
        values["n_chars"] = F.when(same, F.col("__row")["n_chars"]).otherwise(F.length("__new").cast(docs.schema["n_chars"].dataType))
    return found.select(*[values.get(c, F.col("__row")[c]).alias(c) for c in names])
