"""Robust multivariate outliers of text statistics, in DataFrame functions only.

Each document has base counts, and from them a vector of transformed statistics. For each language and
source a minimum-covariance-determinant estimate (mean and covariance of the most concentrated part of
the documents) tells what is usual there; documents whose Mahalanobis distance from it is beyond a quantile of
the chi-square distribution are rejected.

The estimate runs as passes over a narrow table: a pass computes distances, finds per group the distance that
holds the wanted share of documents (by counting into fine cells, so no group is gathered or sorted),
and sums means and products of that part. These concentration steps lower the determinant every time. They run from
two starts, and the result with the smaller determinant counts. A floor for each statistic is added to the covariance,
so statistics that are constant for most documents do not turn every other value into an outlier.

Languages and the whole table are estimated in the same passes. A language's estimate is drawn towards that of all
documents and a source's towards that of its language, with the weight of `prior` documents. So a source of any size
is judged by its own documents as far as they tell, and every document that passes the base rules has a distance.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickledger.llm.base import let
from tickledger.workspace import pin, pin_alone

WORD = r"[^\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Settings:
    """`share` of a group that its estimate rests on, number of `steps`, weight of the wider estimate (`prior`) in documents.

    `cutoff` is the squared distance beyond which a document is rejected: the 0.99999 quantile of chi-square with
    five degrees of freedom. `consistency` scales the covariance of the inner share to that of all: for
    normal data of five dimensions and a share of 0.75, share / P(chi-square of 7 degrees <= its 0.75 quantile of 5).
    `floors` are standard deviations that are no news in any group, in the order of STATISTICS.
    """

    share: float = 0.75
    steps: int = 5
    prior: float = 100.0
    cutoff: float = 30.86
    consistency: float = 1.412
    floors: tuple[float, ...] = (0.25, 0.05, 0.5, 0.5, 0.1)


#: Transformed statistics: log of the length, log of the mean word length, log of symbols per hundred words,
#: log of repeated lines per hundred words, square root of the share of repeated words.
STATISTICS: dict[str, Callable[[], Column]] = {
    "x0": lambda: F.log1p("n_words"),
    "x1": lambda: F.log1p(F.col("word_chars") / F.greatest("n_words", F.lit(1))),
    "x2": lambda: F.log1p(100 * F.col("n_symbols") / F.greatest("n_words", F.lit(1))),
    "x3": lambda: F.log1p(100 * F.col("n_dup_lines") / F.greatest("n_words", F.lit(1))),
    "x4": lambda: F.sqrt(F.col("n_repeat_words") / F.greatest("n_words", F.lit(1))),
}
DIMENSIONS = tuple(STATISTICS)
#: Keys of the estimates that a document adds to: its language and source, its language, all.
LEVELS: dict[str, Callable[[], Column]] = {
    "own": lambda: F.xxhash64(F.lit(0), F.col("doc_lang").isNull(), "doc_lang", F.col("doc_source").isNull(), "doc_source"),
    "of_lang": lambda: F.xxhash64(F.lit(1), F.col("doc_lang").isNull(), "doc_lang"),
    "of_all": lambda: F.xxhash64(F.lit(2)),
}


def repeated_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more, the first included, by one sort of the windows.

    Equal windows are neighbours after sorting by their hash; sorted again by place, each repeated window adds
    the words that the one before it has not covered.
    """

    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        return F.array_sort(F.transform(places, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        def again(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(s, again), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    several = let(words, lambda w: let(windows(w), lambda s: let(repeated(s), covered)))
    return F.when(F.size(words) >= 4, several).otherwise(0)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs` and the counts of BASE (long) over the whole text; null counts as no words.

    Columns already named like a count are replaced.
    """
    value = F.coalesce(docs[text], F.lit(""))
    words = F.regexp_extract_all(value, F.lit(f"({WORD})"), F.lit(1))
    # lines with a word; a line repeats an earlier one if it is not the first of its kind
    lines = F.filter(F.split(value, "\n"), lambda line: line.rlike(WORD))
    row = F.struct(*[docs[c] for c in docs.columns if c not in BASE]).alias("doc_row")
    split = docs.select(row, words.alias("doc_words"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("doc_dups"), (F.length(value) - F.length(F.regexp_replace(value, "[#*$%&|<>]", ""))).alias("doc_symbols"), F.length(F.regexp_replace(value, r"[\x20\x09-\x0D]+", "")).alias("doc_chars"))
    counts = (F.size("doc_words"), F.col("doc_chars"), F.col("doc_symbols"), F.col("doc_dups"), repeated_words(F.col("doc_words")))
    return split.select("doc_row.*", *[c.cast("long").alias(n) for n, c in zip(BASE, counts, strict=True)])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, settings: Settings = Settings(), keep: tuple[str, ...] | None = None, text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """The columns `keep` of `docs` (all by default), the counts of BASE, `base_failed` and `kept`.

    A document is kept if it does not fail the base rules and is no outlier of its group. Null languages and
    sources are groups of their own; rows that repeat are judged each and alike; an empty table gives no rows.
    Estimates rest on all documents that pass the base rules. Columns already named like a result are replaced.
    """
    made = (*BASE, "base_failed", "kept")
    carried = F.struct(*[docs[c] for c in keep or docs.columns if c not in made]).alias("carried")
    counted = base_counts(docs.select(carried, docs[text].alias("counted_text"), docs[language].alias("doc_lang"), docs[source].alias("doc_source")), "counted_text")
    table = pin(counted.drop("counted_text").withColumn("base_failed", base_failed()), "statistics")
    distance = squared_distance(table, settings)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= settings.cutoff, F.lit(True))
    return distance.select("carried.*", *BASE, "base_failed", kept.alias("kept"))


def squared_distance(table: DataFrame, settings: Settings) -> DataFrame:
    """`table` with `distance`, null only where a language and source has no document that passes the base rules."""
    placed = table.select("*", *[make().alias(name) for name, make in (STATISTICS | LEVELS).items()])
    judges = pin_alone(table.sparkSession, lambda: _judges(placed, settings), "judges")
    return _with_distance(placed, judges, "own").drop(*LEVELS)


def _judges(placed: DataFrame, settings: Settings) -> DataFrame:
    """The estimate, with its factor, that the documents of each language and source are judged by."""
    narrow = pin(placed.where(~F.col("base_failed")).select(*LEVELS, *DIMENSIONS), "vectors")
    inner = narrow.select(F.explode(F.array(*LEVELS)).alias("group"), *DIMENSIONS)
    factor = pin(factored(starts(inner, settings)), "factor")
    for _ in range(settings.steps):
        factor = pin(factored(concentrated(inner, factor, settings)), "factor")
    sizes = inner.groupBy("group").agg(F.count("*").alias("size"))
    estimates = pin(smallest(factor).join(sizes, "group"), "estimates")
    return factored(shrunk(narrow.select(*LEVELS).distinct(), estimates, settings))


def smallest(factor: DataFrame) -> DataFrame:
    """Of each group's starts the estimate whose covariance has the smallest determinant."""
    size = sum((F.log(f"l{i}{i}") for i in range(1, len(DIMENSIONS))), F.log("l00"))
    first = F.min_by(F.struct(*ESTIMATE), F.struct(F.round(size, 9).alias("size"), F.col("start")))
    return factor.groupBy("group").agg(first.alias("of")).select("group", "of.*")


def shrunk(keys: DataFrame, estimates: DataFrame, settings: Settings) -> DataFrame:
    """For each language and source its estimate, drawn towards that of the language, itself drawn towards that of all.

    An estimate over n documents has the weight n / (n + prior).
    """
    out = keys
    for level in LEVELS:
        weight = F.col("size") / (F.col("size") + settings.prior)
        named = estimates.select(F.col("group").alias(level), weight.alias(f"{level}_weight"), *[F.col(e).alias(f"{level}_{e}") for e in ESTIMATE])
        out = out.join(named, level)

    def drawn(e: str) -> Column:
        share, wider = F.col("own_weight"), F.col("of_lang_weight")
        language = wider * F.col(f"of_lang_{e}") + (1 - wider) * F.col(f"of_all_{e}")
        return share * F.col(f"own_{e}") + (1 - share) * language

    return out.select("own", *[drawn(e).alias(e) for e in ESTIMATE])


def starts(inner: DataFrame, settings: Settings) -> DataFrame:
    """First estimates of each group: medians with squared median deviations (0), mean and covariance of all its rows (1)."""
    medians = pin(_medians(inner, [F.col(x) for x in DIMENSIONS]), "medians")
    centred = inner.join(medians, "group").select("group", *[F.abs(F.col(x) - F.col(f"m{i}")).alias(x) for i, x in enumerate(DIMENSIONS)])
    spread = _medians(centred, [F.col(x) for x in DIMENSIONS]).select("group", *[F.col(f"m{i}").alias(f"d{i}") for i in range(len(DIMENSIONS))])
    spread = medians.join(spread, "group")
    # 1.4826 times the median deviation is a standard deviation for normal data
    pairs = [(F.pow(F.col(f"d{i}") * 1.4826, 2) + settings.floors[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _lower()]
    middle = spread.select("group", F.lit(0).alias("start"), *[f"m{i}" for i in range(len(DIMENSIONS))], *pairs)
    return middle.unionByName(_moments(inner.withColumn("start", F.lit(1)), settings, 1.0))


def _lower() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(DIMENSIONS)) for j in range(i + 1)]


ESTIMATE = (*[f"m{i}" for i in range(len(DIMENSIONS))], *[f"c{i}{j}" for i, j in _lower()])


def _moments(rows: DataFrame, settings: Settings, scale: float) -> DataFrame:
    """Mean and covariance, times `scale`, of the rows of each group and start."""
    means = [F.avg(x).alias(f"a{i}") for i, x in enumerate(DIMENSIONS)]
    products = [F.covar_pop(DIMENSIONS[i], DIMENSIONS[j]).alias(f"v{i}{j}") for i, j in _lower()]
    sums = rows.groupBy("group", "start").agg(*means, *products)
    # sums depend on the order of rows in their last digits; rounding keeps the verdicts from doing so
    mean = [F.round(f"a{i}", 9).alias(f"m{i}") for i in range(len(DIMENSIONS))]
    covariance = [F.round(F.col(f"v{i}{j}") * scale + (settings.floors[i] ** 2 if i == j else 0.0), 9).alias(f"c{i}{j}") for i, j in _lower()]
    return sums.select("group", "start", *mean, *covariance)


def _medians(rows: DataFrame, values: list[Column]) -> DataFrame:
    """`group, m0 ..`, by counting values into cells of 1/512."""
    cells = rows.select("group", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.round(v * 512).cast("long").alias("cell")) for i, v in enumerate(values)])).alias("x")).select("group", "x.*")
    counts = cells.groupBy("group", "i", "cell").count()
    at = _quantile(counts, ["group", "i"], 0.5).select("group", "i", (F.col("cell") / 512).alias("m"))
    return at.groupBy("group").agg(*[F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"m{i}") for i in range(len(values))])


def _quantile(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The first cell up to which `share` of the rows of each key lie."""
    names = ", ".join(keys)
    running = counts.selectExpr("*", f"sum(count) over (partition by {names} order by cell) as upto", f"sum(count) over (partition by {names}) as total")
    return running.where(F.col("upto") >= F.ceil(share * F.col("total"))).groupBy(*keys).agg(F.min("cell").alias("cell"))


def factored(estimate: DataFrame) -> DataFrame:
    """The estimates and the Cholesky factor L (`l00 ..`) of each covariance."""

    def rest(i: int, j: int) -> Column:
        left = F.col(f"c{i}{j}")
        for k in range(j):
            left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        return left

    factor = estimate
    for j in range(len(DIMENSIONS)):  # a column of L at a time, so that plans stay short
        factor = factor.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest(j, j), F.lit(1e-12))))
        if below := {f"l{i}{j}": rest(i, j) / F.col(f"l{j}{j}") for i in range(j + 1, len(DIMENSIONS))}:
            factor = factor.withColumns(below)
    return factor


def _with_distance(rows: DataFrame, factor: DataFrame, key: str) -> DataFrame:
    """Rows with the squared Mahalanobis distance from the estimates of their `key`, and their `start` if there are several.

    A row solves L z = x - mean, and its distance is the sum of z squared.
    """
    d = len(DIMENSIONS)
    out = rows.join(factor.drop(*[f"c{i}{j}" for i, j in _lower()]), key, "left")
    for i in range(d):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    total = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, d)), F.col("z0") * F.col("z0"))
    return out.select(*rows.columns, *[c for c in factor.columns if c == "start"], total.alias("distance"))


def concentrated(inner: DataFrame, factor: DataFrame, settings: Settings) -> DataFrame:
    """One concentration step: mean and covariance of the share of each group that is nearest to its estimate."""
    near = _with_distance(inner, factor, "group").where("distance is not null")
    # cells of one percent of the distance; the share ends with the cell that reaches it
    near = near.withColumn("cell", F.floor(F.log(F.col("distance") + 1e-6) * 100))
    # one row per group and start; written, so that its size is known and a hot group need not be moved for it
    keys = ["group", "start"]
    limit = pin(_quantile(near.groupBy(*keys, "cell").count(), keys, settings.share), "limits").withColumnRenamed("cell", "last")
    return _moments(near.join(limit, keys).where("cell <= last"), settings, settings.consistency)
