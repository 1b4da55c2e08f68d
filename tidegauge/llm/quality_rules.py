r"""Quality rules whose cutoffs are set under a proven risk, with built-in expressions only.

Each rule rejects a document whose ratio exceeds a cutoff. For every stratum (language) and every rule, the
cutoffs of a fixed grid are tested on the labelled good documents: a cutoff is admissible if, were its true
rate of false rejection `rule_risk` or more, so few rejections among n good documents would have a probability
of at most delta / (strata * rules * cutoffs): an exact binomial tail with Bonferroni's correction. With
probability 1 - delta no stratum loses more than rules * rule_risk of those good documents that pass the base rule, which
is fixed, not learnt, and comes first. Of a rule's admissible cutoffs the one with the largest gain is used: the share of labelled
bad documents that it rejects less `price` times that of good ones; equal gains take the highest cutoff. A rule
without an admissible cutoff (too few labels) or without any gain rejects nothing in that stratum.

Words are `[^\x20\x09-\x0D]+`. Defined results: null and wordless texts have zeros and fail the base rule;
a null stratum is a stratum of its own; repeated rows are each judged; very long texts are taken whole; an empty table
gives no rows; labels of unknown documents, null labels and conflicting labels (the worst counts) are no obstacle; columns
other than the named ones are never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Risk:
    """Each cutoff is a ratio that must not be exceeded."""

    delta: float = 0.05
    rule_risk: float = 0.01
    price: int = 10
    cutoffs: dict = field(
        default_factory=lambda: {
            "symbols_per_word": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5],
            "shouts_per_word": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5],
            "repeat_share": [0.01, 0.02, 0.05, 0.1, 0.15],
            "dup_line_share": [0.05, 0.1, 0.2, 0.3, 0.5],
            "chars_per_word": [9.0, 10.0, 12.0, 15.0, 20.0],
            "same_neighbour_share": [0.02, 0.05, 0.1, 0.2, 0.3],
        }
    )


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the base counts and the ratios of the rules."""
    text = F.coalesce("text", F.lit(""))
    words = docs.select("doc_id", "stratum", text.alias("text"), F.array_remove(F.split(text, C.SPACE_RUN, -1), "").alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(C.SPACED_WORD))
    marks = F.regexp_replace("text", r"[^#*$%&|<>!]+", "")
    words = words.select("doc_id", "stratum", "words", marks.alias("marks"), lines.alias("lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    grams = F.expr("if(size(h) < 5, cast(array() as array<bigint>), transform(sequence(1, size(h) - 4), i -> xxhash64(h[i - 1], h[i], h[i + 1], h[i + 2], h[i + 3])))")
    wide = words.select(
        "doc_id", "stratum", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.replace("marks", F.lit("!"), F.lit(""))).cast("long").alias("n_symbols"), F.length("marks").alias("n_marks"), "lines", grams.alias("grams"),
        F.expr("size(filter(h, (x, i) -> x = get(h, i - 1)))").alias("n_same"),
    )
    wide = wide.select("*", (F.col("n_marks") - F.col("n_symbols")).alias("n_shouts"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").alias("n_lines"))
    # Positions of windows found twice or more, from neighbours in hash order; each covers five words, but not past the next one's.
    sorted_grams = F.sort_array(F.expr("transform(grams, (x, i) -> struct(x as h, i as i))"))
    twice = wide.select("*", (F.size(F.array_distinct("grams")) < F.size("grams")).alias("twice"))
    twice = twice.withColumn("pairs", F.when(F.col("twice"), sorted_grams))
    at = F.expr("sort_array(array_distinct(flatten(zip_with(slice(pairs, 1, size(pairs) - 1), slice(pairs, 2, size(pairs) - 1), (a, b) -> if(a.h = b.h, array(a.i, b.i), cast(array() as array<int>))))))")
    placed = twice.drop("grams", "lines").withColumn("at", F.when(F.col("twice"), at))
    gaps = F.expr("aggregate(zip_with(slice(at, 1, size(at) - 1), slice(at, 2, size(at) - 1), (a, b) -> least(5, b - a)), 5L, (n, x) -> n + x)")
    done = placed.withColumn("n_repeat_words", F.when(F.col("twice"), gaps).otherwise(F.lit(0).cast("long")))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return done.select(
        "doc_id", "stratum", *BASE,
        per("n_symbols", "n_words").alias("symbols_per_word"), per("n_shouts", "n_words").alias("shouts_per_word"), per("n_repeat_words", "n_words").alias("repeat_share"),
        per("n_dup_lines", "n_lines").alias("dup_line_share"), per("word_chars", "n_words").alias("chars_per_word"),
        per("n_same", "n_words").alias("same_neighbour_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def thresholds(marked: DataFrame, risk: Risk) -> DataFrame:
    """(stratum, rule, cutoff): of the admissible cutoffs the one that serves best; `marked` has stratum, ratios and good (boolean)."""
    grid = [(rule, cut) for rule, cuts in risk.cutoffs.items() for cut in cuts]
    over = lambda rule, cut, good: F.count_if((F.col(rule) > cut) & (F.col("good") == good))
    counts = marked.groupBy("stratum").agg(
        F.count_if("good").alias("n"), F.count_if(~F.col("good")).alias("m"),
        *[over(rule, cut, True).alias(f"k{i}") for i, (rule, cut) in enumerate(grid)], *[over(rule, cut, False).alias(f"b{i}") for i, (rule, cut) in enumerate(grid)],
    ).filter("n > 0")
    strata = counts.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("strata"))
    tests = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(float(cut)).alias("cutoff"), F.col(f"k{i}").alias("k"), F.col(f"b{i}").alias("b")) for i, (rule, cut) in enumerate(grid)])).alias("t")
    tried = counts.crossJoin(F.broadcast(strata)).select("stratum", "n", "m", "strata", tests).select("stratum", "n", "m", "strata", "t.*")
    p = risk.rule_risk
    # log of P(Bin(n, p) <= k), term by term from j = 0; only where k is below the mean, elsewhere the tail is no evidence.
    step = f"a.t + ln((n - j + 1) / j) + ln({p}D / (1 - {p}D))"
    tail = F.expr(f"""aggregate(sequence(1, cast(k as int)), named_struct('t', n * ln(1 - {p}D), 's', n * ln(1 - {p}D)),
        (a, j) -> named_struct('t', {step}, 's', greatest(a.s, {step}) + ln(1 + exp(-abs(a.s - ({step}))))), a -> a.s)""")
    log_tail = F.when(F.col("k") == 0, F.col("n") * F.log(F.lit(1 - p))).when(F.col("k") < F.col("n") * p, tail)
    admissible = tried.filter(log_tail <= F.log(F.lit(risk.delta) / (F.col("strata") * len(grid))))
    # Both shares are counts over the stratum's labels, so they are compared as whole numbers.
    gain = F.col("b") * F.col("n") - risk.price * F.col("k") * F.col("m")
    best = admissible.withColumn("gain", gain).filter("gain > 0").groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("best"))
    return best.select("stratum", "rule", F.col("best.cutoff").alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality") -> DataFrame:
    """One row for each document: doc_id, the base counts, base_failed, kept, stratum and broken (the rules whose cutoff it exceeds)."""
    known = C.materialize(features(C.intake(docs, doc_id=doc_id, text=text, stratum=stratum)), "features")
    marks = labels.select(labels[doc_id].alias("m_id"), labels[label].alias("m")).filter("m is not null").groupBy("m_id").agg(F.min("m").alias("m"))
    marked = known.filter(~base_failed()).join(marks, F.col("doc_id") == F.col("m_id")).withColumn("good", F.col("m") > 0)
    cuts = C.materialize(thresholds(marked, risk), "cutoffs")
    # One row for each stratum; a stratum without any cutoff has none. The number of strata is counted before it is broadcast.
    table = cuts.groupBy("stratum").pivot("rule", list(risk.cutoffs)).agg(F.min("cutoff"))
    table = table.select(F.col("stratum").alias("c_stratum"), *[F.col(rule).alias(f"c_{rule}") for rule in risk.cutoffs])
    table = F.broadcast(table) if table.count() <= 10_000 else table
    judged = known.join(table, F.col("stratum").eqNullSafe(F.col("c_stratum")), "left")
    broken = F.filter(F.array(*[F.when(F.col(rule) > F.col(f"c_{rule}"), F.lit(rule)) for rule in risk.cutoffs]), lambda x: x.isNotNull())
    judged = judged.select("doc_id", *BASE, base_failed().alias("base_failed"), "stratum", broken.alias("broken"))
    return judged.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "stratum", "broken")


def oracle(risk: Risk = Risk()) -> str:
    """The same in DuckDB's SQL."""
    grid = [(rule, cut) for rule, cuts in risk.cutoffs.items() for cut in cuts]
    p, tests = risk.rule_risk, ", ".join(f"('{rule}', {cut})" for rule, cut in grid)
    value = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {rule}" for rule in risk.cutoffs) + " END"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
base AS (SELECT d.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^!]+', '', 'g')) AS n_shouts, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
    len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_own_lines,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_same, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_lines - n_own_lines AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbols_per_word, n_shouts / greatest(n_words, 1) AS shouts_per_word,
    n_repeat_words / greatest(n_words, 1) AS repeat_share, (n_lines - n_own_lines) / greatest(n_lines, 1) AS dup_line_share, word_chars / greatest(n_words, 1) AS chars_per_word,
    n_same / greatest(n_words, 1) AS same_neighbour_share FROM base),
t(rule, cutoff) AS (VALUES {tests}),
marked AS (SELECT f.*, m > 0 AS good FROM f JOIN (SELECT doc_id, min(quality) AS m FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
k AS (SELECT lang, rule, cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE NOT good) AS m, count(*) FILTER (WHERE good AND {value} > cutoff) AS k, count(*) FILTER (WHERE NOT good AND {value} > cutoff) AS b FROM marked, t GROUP BY ALL HAVING n > 0),
tail AS (SELECT *, CASE WHEN k < n * {p} OR k = 0 THEN list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p})))) END AS pr FROM k),
c AS (SELECT lang, rule, arg_max(cutoff, (b * n - {risk.price} * k * m, cutoff)) AS cutoff FROM tail
    WHERE pr <= {risk.delta} / ((SELECT count(DISTINCT lang) FROM k) * {len(grid)}) AND b * n > {risk.price} * k * m GROUP BY ALL),
b AS (SELECT DISTINCT doc_id FROM f JOIN c USING (lang) WHERE {value} > cutoff)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND b.doc_id IS NULL AS kept FROM f LEFT JOIN b USING (doc_id)
"""
