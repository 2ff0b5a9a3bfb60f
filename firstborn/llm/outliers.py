"""Quality rules with a multivariate check: robust outliers per language and source.

Statistics are plain array expressions on the text's words and lines.  For every language
and source, a minimum-covariance-determinant estimate (the mean and covariance of the three
quarters of rows that lie closest together) is refined by concentration steps; a document is
rejected when the Mahalanobis distance of its transformed statistics is too large.
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import skew_join
from ..session import persist_reliably
from .common import SPACES, WORD_BREAK, whole_text

#: Share of the rows that an estimate rests on.
CORE = 0.75
#: Consistency of the core's covariance with the whole of a 4-variate normal: CORE / P(chi2_6 <= chi2_4 quantile of CORE).
CONSISTENCY = 1.48
#: chi-square with 4 degrees of freedom, 99.999 %.
CUTOFF = 28.5
#: Deviations no smaller than these count as one unit: statistics that are nearly constant in a
#: group must not make small changes outliers.
FLOORS = {"x_length": 0.12, "x_symbols": 0.06, "x_lines": 0.2, "x_repeats": 0.15}
STATISTICS = tuple(FLOORS)
#: Groups with fewer used rows take the estimate of all used rows of their language, and that failing of all used rows.
FEWEST = 100
STEPS = 3


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK))


def _covered(places: Column) -> Column:
    """Words in the 3-word windows at these ascending places."""
    return F.aggregate(
        places,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")),
        lambda s: s["n"],
    )


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows found twice or more.

    Windows are sorted by hash within the row and compared with their neighbours.  Up to
    2^16 words, 48 bits of the hash and the place share one long, which sorts fast; the whole
    hash decides.  Longer texts sort (hash, place) pairs.
    """

    def packed(grams: Column) -> Column:
        cells = F.sort_array(
            F.transform(grams, lambda h, i: h.bitwiseAND(F.lit(-65536)).bitwiseOR(i.cast("bigint")))
        )

        def places(p: Column) -> Column:
            def same(x: Column, k: Column) -> Column:
                y = F.get(p, k)
                return (F.shiftright(x, 16) == F.shiftright(y, 16)) & (
                    F.get(grams, x.bitwiseAND(F.lit(65535)).cast("int")) == F.get(grams, y.bitwiseAND(F.lit(65535)).cast("int"))
                )

            twice = F.filter(p, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.lit(65535)).cast("int")))

        return _covered(let(cells, places))

    def paired(grams: Column) -> Column:
        cells = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            twice = F.filter(
                p,
                lambda x, k: F.coalesce(x["h"] == F.get(p, k - 1)["h"], F.lit(False))
                | F.coalesce(x["h"] == F.get(p, k + 1)["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        return _covered(let(cells, places))

    def count(w: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )
        return (
            F.when(F.size(w) < 4, F.lit(0).cast("bigint"))
            .when(F.size(w) <= 65536, let(grams, packed))
            .otherwise(let(grams, paired))
        )

    return let(words, count)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    facts = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    line_facts = let(
        lines,
        lambda a: F.struct(
            F.size(a).cast("bigint").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("n_dup_lines")
        ),
    )
    symbols = F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint")
    return (
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
            F.col("source").cast("string").alias("source"), whole_text().alias("_text"),
        )
        .select("doc_id", "lang", "source", facts.alias("f"), line_facts.alias("g"), symbols.alias("n_symbols"))
        .select("doc_id", "lang", "source", "f.*", "g.*", "n_symbols")
    )


def transformed(stats: DataFrame) -> DataFrame:
    """The statistics on scales where they are roughly symmetric."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return stats.withColumns(
        {
            "x_length": F.ln(chars / words),
            "x_symbols": F.sqrt(F.col("n_symbols") / chars),
            "x_lines": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
            "x_repeats": F.sqrt(F.col("n_repeat_words") / words),
        }
    )


def estimation_groups(rows: DataFrame, fewest: int) -> DataFrame:
    """Adds grp, the estimate that judges the row, and grps, the estimates that it enters if used.

    A row is judged by its (lang, source), by its lang or by everything, the first that has
    enough used rows.  Every used row of a language or of everything enters that estimate;
    estimates that judge no row are left out.
    """
    pair = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    lang = F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})
    named = rows.withColumns({"_pair": pair, "_lang": lang})
    pairs = persist_reliably(named.groupBy("_pair", "_lang").agg(F.count("*").alias("_rows"), F.count_if("used").alias("_np")))
    few_pair, few_lang = F.col("_np") < fewest, F.col("_nl") < fewest
    langs = persist_reliably(pairs.groupBy("_lang").agg(F.sum("_np").alias("_nl"), F.max(few_pair).alias("_asked")))
    every = langs.agg(F.max(few_lang).alias("_every"))  # one row
    grp = F.when(~few_pair, F.col("_pair")).when(~few_lang, F.col("_lang")).otherwise(F.lit(""))
    entered = F.array(F.when(~few_pair, F.col("_pair")), F.when(F.col("_asked") & ~few_lang, F.col("_lang")), F.when(F.col("_every"), F.lit("")))
    chosen = pairs.join(langs, "_lang").join(F.broadcast(every), F.lit(True)).select("_pair", "_rows", grp.alias("grp"), F.array_compact(entered).alias("grps"))
    return skew_join(named, persist_reliably(chosen), ["_pair"], size="_rows", spread="doc_id").drop("_pair", "_lang", "_rows")


def _distance(mean: str, root: str) -> Column:
    """Squared Mahalanobis distance by forward substitution with a Cholesky factor in columns."""
    solved: list[Column] = []
    for i, x in enumerate(STATISTICS):
        rest = F.col(x) - F.col(f"{mean}{i}")
        for k in range(i):
            rest = rest - F.col(f"{root}{i}_{k}") * solved[k]
        solved.append(rest / F.col(f"{root}{i}_{i}"))
    return reduce(lambda a, b: a + b, [s * s for s in solved])


def _moments(core: DataFrame) -> DataFrame:
    """Mean and Cholesky factor of the core's covariance, per group and start."""
    size = len(STATISTICS)
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(STATISTICS)]
    products = [
        F.covar_pop(F.col(STATISTICS[i]), F.col(STATISTICS[j])).alias(f"c{i}_{j}") for i in range(size) for j in range(i + 1)
    ]
    out = core.groupBy("grp", "start").agg(F.count("*").alias("rows"), *sums, *products)
    for i in range(size):
        out = out.withColumn(f"c{i}_{i}", F.col(f"c{i}_{i}") + F.lit(FLOORS[STATISTICS[i]] ** 2 / CONSISTENCY))
    for i in range(size):
        for j in range(i + 1):
            rest = F.col(f"c{i}_{j}") * CONSISTENCY
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            root = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}_{j}")
            out = out.withColumn(f"l{i}_{j}", root)
    det = reduce(lambda a, b: a + b, [F.ln(F.col(f"l{i}_{i}")) for i in range(size)])
    return out.withColumn("det", F.round(det, 9)).drop(*[f"c{i}_{j}" for i in range(size) for j in range(i + 1)])


def _core(rows: DataFrame, distance: Column) -> DataFrame:
    """The rows of each group and start within the CORE quantile of the distance, on a grid of 2 %.

    The grid makes the exact percentile a merge of small histograms, whatever the group's size.
    """
    placed = rows.withColumn("_d", F.floor(F.ln(distance + 1) * 50).cast("int"))
    limit = persist_reliably(placed.groupBy("grp", "start").agg(F.percentile("_d", F.lit(CORE)).alias("_limit"), F.count("*").alias("_rows")))
    # A group may hold a third of all rows, so joins back to rows split it.
    return skew_join(placed, limit, ["grp", "start"], size="_rows", spread=STATISTICS).filter(F.col("_d") <= F.ceil("_limit")).drop("_rows")


def covariance_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """grp, mean m* and Cholesky factor l* with the least determinant over two starts.

    Starts: coordinate medians with median absolute deviations, and with the floors as scales.
    """
    used = rows.filter("used").select(F.explode("grps").alias("grp"), *STATISTICS)
    middle = persist_reliably(
        used.groupBy("grp").agg(
            F.count("*").alias("_rows"), *[F.percentile(F.round(x, 2), F.lit(0.5)).alias(f"_m{i}") for i, x in enumerate(STATISTICS)]
        )
    )
    spread = (
        skew_join(used, middle, ["grp"], size="_rows", spread=STATISTICS)
        .groupBy("grp")
        .agg(
            F.first("_rows").alias("_rows"),
            *[F.first(f"_m{i}").alias(f"_m{i}") for i in range(len(STATISTICS))],
            *[
                F.greatest(F.percentile(F.round(F.abs(F.col(x) - F.col(f"_m{i}")), 2), F.lit(0.5)) * 1.4826, F.lit(FLOORS[x])).alias(f"_s{i}")
                for i, x in enumerate(STATISTICS)
            ],
        )
    )
    spread = persist_reliably(spread)
    first = skew_join(used, spread, ["grp"], size="_rows", spread=STATISTICS).drop("_rows").withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    scaled = [
        (F.col(x) - F.col(f"_m{i}")) / F.when(F.col("start") == 0, F.col(f"_s{i}")).otherwise(F.lit(FLOORS[x]))
        for i, x in enumerate(STATISTICS)
    ]
    estimate = persist_reliably(_moments(_core(first, reduce(lambda a, b: a + b, [s * s for s in scaled]))))
    for _ in range(steps):
        near = skew_join(used, estimate, ["grp"], size="rows", spread=STATISTICS).drop("rows")
        estimate = persist_reliably(_moments(_core(near, _distance("m", "l"))))
    names = [c for c in estimate.columns if c not in ("grp", "start", "det")]
    best = estimate.groupBy("grp").agg(F.min(F.struct("det", "start", *names)).alias("best"))
    return best.select("grp", *[F.col(f"best.{n}").alias(n) for n in names])


def quality_rules(docs: DataFrame, fewest: int = FEWEST, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, distance (squared) and kept of every row.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows.
    Such rows are rejected and left out of the estimates.  A null text has no words.  Null
    languages and sources are groups of their own; repeated rows count each; an empty table
    gives no rows; other columns are ignored.
    """
    stats = text_statistics(docs)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rows = persist_reliably(transformed(stats).withColumn("base_failed", failed).withColumn("used", ~failed))
    rows = persist_reliably(estimation_groups(rows, fewest))
    estimates = persist_reliably(covariance_estimates(rows))
    judged = skew_join(rows, estimates, ["grp"], size="rows", spread="doc_id", how="left").withColumn("distance", _distance("m", "l"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return judged.withColumn("kept", kept).select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        "base_failed", "distance", "kept",
    )
