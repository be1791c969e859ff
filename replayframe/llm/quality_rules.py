"""Quality rules: decision lists learned by sequential covering.

Statistics of each whole text are plain column expressions.  A list is learned
from labelled statistics: a rule grows by the threshold condition with the best
information gain, counted by Spark over the rows that no earlier rule covers,
and is pruned to the prefix that does best on rows held back; rules are added
while they stay precise there.  The driver only sees counts by statistic and
threshold bin.  The list is emitted as an ordered ``CASE`` expression.  Only
DataFrame functions are used.

Defined results: a null or empty text has no words and fails the base rules;
rows without a label, or with a null one, aren't learned from, an id with both
labels counts as poor, and without any usable label the list is empty; of equal
gains the first statistic, the lowest threshold and "at most" win; repeated
rows are judged each for itself; an empty table gives an empty one; other
columns pass through ``keep_good``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, discard, fields, materialize, struct_of, words

#: Words of a window whose second finding in a text is a repeat.
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
SYMBOLS = "#*$%&|<>"
#: Thresholds of each statistic that conditions may use.
BINS = 16
MOST_RULES, MOST_CONDITIONS = 8, 3
#: Labelled rows that are learned from, at most; of more, those with the smallest hash.
MOST_LABELS = 50_000
#: Share of poor rows among those held back that a rule covers, and their least number.
PRECISION, COVER = 0.9, 4


def _repeated(ws: Column, window: int) -> Column:
    """Words in windows found twice or more, the first finding included."""
    n = F.size(ws)

    def covered(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            before = lambda k: F.coalesce(F.get(s, k - 1)["h"] == F.get(s, k)["h"], F.lit(False))
            return F.filter(s, lambda x, k: before(k) | before(k + 1))

        at = F.sort_array(F.transform(bind(pairs, starts), lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            at,
            zero,
            lambda a, p: F.struct((a["n"] + window - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + window).alias("end")),
            lambda a: a["n"],
        )

    def hashed(hs: Column) -> Column:
        wins = F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(hs, i, window)))
        return bind(wins, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))

    return F.when(n <= window, 0).otherwise(bind(F.transform(ws, lambda x: F.xxhash64(x)), hashed))


def _count(text: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


#: The statistics, in the order of ``with_statistics``.
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks")


def with_statistics(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the statistics of ``text`` as ``__<name>`` columns."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(ws: Column, ls: Column) -> Column:
        values = (
            F.size(ws),
            F.length(F.array_join(ws, "")),
            _count(whole, r"#*$%&|<>"),
            F.size(ls) - F.size(F.array_distinct(ls)),
            _repeated(ws, WINDOW),
            F.size(ls),
            F.size(F.array_distinct(ws)),
            _count(whole, r"\p{Lu}"),
            _count(whole, r"\p{Nd}"),
            _count(whole, r"!?.,;:"),
        )
        return F.struct(*[v.cast("long").alias(f"__{n}") for n, v in zip(STATISTICS, values)])

    stats = F.transform(F.array(words(F.col(text))), lambda ws: bind(lines, lambda ls: of(ws, ls)))
    return df.select("*", F.inline(stats))


def base_failed() -> Column:
    n, r = F.col("__n_words"), F.col("__n_repeat_words")
    return (n < LEAST_WORDS) | (100 * r > MOST_REPEATED * n)


def features() -> dict[str, Column]:
    """What conditions test, by name: rates that any text has."""
    c = {n: F.col(f"__{n}").cast("double") for n in STATISTICS}
    chars, n, lines = F.greatest(c["word_chars"], F.lit(1.0)), F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["n_lines"], F.lit(1.0))
    return {
        "words": c["n_words"],
        "chars_a_word": c["word_chars"] / n,
        "symbols_a_char": c["n_symbols"] / chars,
        "duplicate_lines": c["n_dup_lines"] / lines,
        "repeated_words": c["n_repeat_words"] / n,
        "words_a_line": n / lines,
        "distinct_words": c["n_distinct"] / n,
        "capitals_a_char": c["n_upper"] / chars,
        "digits_a_char": c["n_digits"] / chars,
        "marks_a_word": c["n_marks"] / n,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules, each a conjunction; a text that none fits is good."""

    rules: tuple[tuple[Condition, ...], ...]

    def fits(self, k: int) -> Column:
        out = F.lit(True)
        for c in self.rules[k]:
            out = out & c.column()
        return out

    def column(self) -> Column:
        """The first rule that fits, as text; null for good texts."""
        out = F.lit(None).cast("string")
        for k in reversed(range(len(self.rules))):
            out = F.when(self.fits(k), " and ".join(map(str, self.rules[k]))).otherwise(out)
        return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def labelled(labels: DataFrame, id: str = "doc_id", label: str = "quality", most: int = MOST_LABELS) -> DataFrame:
    """(__id, __poor) of at most ``most`` labelled ids, few enough to broadcast; an id with both labels is poor."""
    known = labels.select(F.col(id).alias("__id"), (F.col(label) == 0).cast("int").alias("__poor")).where("__poor is not null and __id is not null")
    known = known.groupBy("__id").agg(F.max("__poor").alias("__poor"))
    return known.orderBy(F.xxhash64(F.lit("sample"), "__id"), "__id").limit(most)


def learn(statistics: DataFrame, known: DataFrame, id: str = "doc_id") -> DecisionList:
    """The list for rows that are poor in ``known`` (see ``labelled``).

    ``statistics`` has the columns of ``with_statistics`` and ``id``.  A third
    of the ids, by hash, prunes and judges; the others grow.
    """
    names = list(features())
    rows = statistics.select(F.col(id).alias("__id"), *[v.alias(k) for k, v in features().items()]).join(F.broadcast(known), "__id")
    rows = materialize(rows.withColumn("__prune", F.pmod(F.xxhash64("__id"), F.lit(3)) == 0).drop("__id"), "labelled")
    quantiles = [F.percentile_approx(k, [i / BINS for i in range(1, BINS)], 1000).alias(k) for k in names]
    found = rows.agg(*quantiles).first()
    edges = {k: sorted(set(found[k] or [])) for k in names}
    binned = F.array(
        *[
            F.struct(F.lit(k).alias("feature"), F.expr(f"size(filter(array({', '.join(f'{e!r}D' for e in edges[k])}), e -> `{k}` > e))").alias("bin"))
            for k in names
            if edges[k]
        ]
    )

    def test(c: Condition) -> Column:
        return F.col(c.feature) > c.threshold if c.above else F.col(c.feature) <= c.threshold

    def conjunction(cs) -> Column:
        out = F.lit(True)
        for c in cs:
            out = out & test(c)
        return out

    rules: list[tuple[Condition, ...]] = []
    open_ = F.lit(True)
    while len(rules) < MOST_RULES and any(edges.values()):
        rule: list[Condition] = []
        while len(rule) < MOST_CONDITIONS:
            counts = (
                rows.where(open_ & conjunction(rule) & ~F.col("__prune"))
                .select("__poor", F.inline(binned))
                .groupBy("feature", "bin")
                .agg(F.sum("__poor").alias("p"), F.count("*").alias("n"))
                .collect()
            )
            best = _best(counts, edges)
            if best is None:
                break
            rule.append(best[0])
            if best[1] == 0:  # only poor rows are left
                break
        if not rule:
            break
        prefixes = [conjunction(rule[: k + 1]) for k in range(len(rule))]
        sums = rows.where(open_ & F.col("__prune")).agg(
            *[F.sum(F.when(x, F.col("__poor"))).alias(f"p{k}") for k, x in enumerate(prefixes)],
            *[F.count(F.when(x, 1)).alias(f"n{k}") for k, x in enumerate(prefixes)],
        )
        judged = sums.first()
        scores = [((judged[f"p{k}"] or 0) / judged[f"n{k}"] if judged[f"n{k}"] else 0.0, judged[f"p{k}"] or 0) for k in range(len(rule))]
        k = max(range(len(rule)), key=lambda k: (round(scores[k][0], 2), scores[k][1], -k))
        if scores[k][0] < PRECISION or scores[k][1] < COVER:
            break
        rules.append(tuple(rule[: k + 1]))
        open_ = open_ & ~prefixes[k]
    discard(rows)
    return DecisionList(tuple(rules))


def _best(counts, edges: dict[str, list[float]]) -> tuple[Condition, float] | None:
    """The condition of the highest gain, and how many good rows it leaves."""
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r["feature"], {})[r["bin"]] = (r["p"], r["n"] - r["p"])
    best, most = None, 1e-6
    for feature, bins in sorted(by.items()):
        p0, n0 = (sum(x[k] for x in bins.values()) for k in (0, 1))
        p = n = 0
        for b, edge in enumerate(edges[feature]):  # bin b holds the values up to its edge
            p, n = p + bins.get(b, (0, 0))[0], n + bins.get(b, (0, 0))[1]
            for above, x, y in ((False, p, n), (True, p0 - p, n0 - n)):
                gain = _gain(x, y, p0, n0) if p0 else 0.0
                if gain > most and x + y < p0 + n0:
                    best, most = (Condition(feature, above, edge), y), gain
    return best


def judge(statistics: DataFrame, rules: DecisionList) -> DataFrame:
    """``statistics`` with base_failed, rule (the first that fits) and kept."""
    return statistics.withColumns({"base_failed": base_failed(), "rule": rules.column()}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )


def quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", most: int = MOST_LABELS) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule, kept) of each row."""
    some = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text"))
    rows = materialize(with_statistics(some, "__text").drop("__text"), "statistics")
    found = judge(rows, learn(rows, labelled(labels, id, most=most), "__id"))
    return found.select(F.col("__id").alias(id), *[F.col(f"__{n}").alias(n) for n in STATISTICS[:5]], "base_failed", "rule", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", most: int = MOST_LABELS) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged.

    The list is learned from the statistics of the labelled rows alone; then
    every row is judged where it is read, and no text is shuffled.
    """
    known = materialize(labelled(labels, id, most=most), "known")
    some = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), "__id", "left_semi")
    rows = materialize(with_statistics(some, "__text").drop("__text"), "statistics")
    rules = learn(rows, known, "__id")
    discard(rows, known)
    whole = docs.select(struct_of(docs).alias("__row"), F.col(text).alias("__text"))
    return judge(with_statistics(whole, "__text"), rules).where("kept").select(*fields(docs))
