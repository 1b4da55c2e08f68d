"""Mixing to target weights with soft memberships.

A classifier learnt from a labelled table gives every document a posterior over domains. Rates r >= 0 are then fitted so
that the expected token totals of the domains, the sums of r * tokens * posterior, match the targets: least squares by
projected gradient. The gradient of half the squared error by a document's rate is tokens * (posterior . error). Steps are
taken in a metric of their own (a scaled projected gradient): a document's tokens don't count, so that long documents move
no faster than short ones, and the error is multiplied by the inverse of the Gram matrix of tokens * posterior *
posterior over the documents that can move, so that rare domains move as fast as frequent ones. Each pass sums totals and
matrix in the cluster and brings those few numbers to the driver, which shortens a step until the error falls. A rate
depends on the posterior and on the steps so far alone, so no rates are kept between passes. Passes end when the targets
are met, or when no step brings the totals nearer, as with targets out of reach; the result says how far off they are.

Defined results: null and empty texts have no tokens and keep a rate; null labels don't count; a domain without labels has
the posterior that its classifier gives without examples; targets that nonnegative rates can't reach are met as nearly as
least squares can; rows that repeat an id have a rate each; very long texts are taken whole; an empty table gives no rows;
columns other than the named ones are passed through or never read.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import toxicity as T

#: Domains of the labelled table, in the order of their classes.
DOMAINS = ["clean", "toxic", "junk"]


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(quality == 0, 2).when(toxic == 1, 1).when(quality.isNotNull() | toxic.isNotNull(), 0)


def posteriors(docs: DataFrame, labels: DataFrame, cfg: T.Ftrl = T.Ftrl(), keep: list[str] = ["doc_id"], prefix: str = "") -> DataFrame:  # noqa: B006
    """The columns `keep`, n_tokens, p_<domain> (their names after `prefix`): one-against-rest scores made to sum to one."""
    marks = labels.select(F.col("doc_id").alias("m_id"), domain_of(F.col("quality"), F.col("toxic")).alias("m")).groupBy("m_id").agg(F.max("m").alias("y"))
    model = T.fit(docs, marks, F.lit(True), len(DOMAINS), cfg)
    scored = T.class_scores(docs, model, cfg, keep, prefix)
    p = F.col(prefix + "p")
    total = sum((p[k] for k in range(1, len(DOMAINS))), p[0])
    return scored.select(*keep, prefix + "n_tokens", *[(p[k] / total).alias(f"{prefix}p_{d}") for k, d in enumerate(DOMAINS)])


def _rate(steps: list[np.ndarray], start: float, most: float | None, prefix: str) -> Column:
    rate, p = F.lit(float(start)), [F.col(f"{prefix}p_{d}") for d in DOMAINS]
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((x * float(s) for x, s in zip(p[1:], step[1:])), p[0] * float(step[0])))
        rate = F.least(rate, F.lit(float(most))) if most is not None else rate
    return rate


def fit_rates(table: DataFrame, targets: np.ndarray, most: float | None = None, tolerance: float = 1e-4, gain: float = 1e-2, least_step: float = 1e-2, most_passes: int = 100, prefix: str = "") -> tuple[Column, np.ndarray]:
    """The rate of each row of `table` (n_tokens, p_*) and the domain totals that the rates give; targets are token totals.
    Ends when the error is within `tolerance` of the total. A step that takes less than `gain` of the error away makes the
    next ones four times shorter, and steps shorter than `least_step` end the search: no way leads nearer."""
    k = len(DOMAINS)
    p, scale = [F.col(f"p{a}") for a in range(k)], max(1.0, float(np.sum(targets)))
    names = [F.col(f"{prefix}p_{d}").alias(f"p{a}") for a, d in enumerate(DOMAINS)]

    def totals(steps: list[np.ndarray], error: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        # The rate, whose expression grows with the steps, stands in the plan once.
        rows = table.select(F.col(prefix + "n_tokens").alias("n"), *names, _rate(steps, 1.0, most, prefix).alias("w"))
        # A rate at a bound that the error pushes it against can't move.
        pull = sum((x * float(e) for x, e in zip(p[1:], error[1:])), p[0] * float(error[0])) if error is not None else F.lit(0.0)
        moves = ~((F.col("w") <= 0) & (pull > 0))
        moves = moves & ~((F.col("w") >= most) & (pull < 0)) if most is not None else moves
        rows = rows.select("n", *p, "w", F.when(moves, F.col("n")).otherwise(0).alias("m"))
        row = rows.agg(*[F.sum(F.col("w") * F.col("n") * x) for x in p], *[F.sum(F.col("m") * p[a] * p[b]) for a in range(k) for b in range(a, k)]).first()
        row, gram = [x or 0.0 for x in row], np.zeros((k, k))
        for (a, b), x in zip([(a, b) for a in range(k) for b in range(a, k)], row[k:]):
            gram[a, b] = gram[b, a] = x
        return np.array(row[:k]), gram

    steps: list[np.ndarray] = []
    got, gram = totals(steps, None)
    error, size = got - targets, 1.0
    for _ in range(most_passes):
        if np.linalg.norm(error) <= tolerance * scale or size < least_step:
            return _rate(steps, 1.0, most, prefix), got
        ridge = 1e-6 * max(np.trace(gram), scale * 1e-9) * np.eye(k)
        step = size * np.linalg.solve(gram + ridge, error)
        new, new_gram = totals([*steps, step], error)
        less = 1 - np.linalg.norm(new - targets) / np.linalg.norm(error)
        if less > 0:
            steps, got, gram, error = [*steps, step], new, new_gram, new - targets
        size = min(1.0, 2 * size) if less > gain else size / 4
    raise RuntimeError(f"rates still move after {most_passes} passes: {got} of {targets}")


def mix(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], total_tokens: float | None = None, most: float | None = None, seed: str = "mix:", cfg: T.Ftrl = T.Ftrl()) -> DataFrame:
    """One row for each document: doc_id, n_tokens, p_<domain>, rate, copies (the rate rounded up or down by a seeded hash
    of the id, so that its expectation is the rate), and in each row off_<domain>: by how much of the mixture's total the
    domain's expected tokens exceed its target. `total_tokens`: of the mixture; None: as many as there are."""
    docs = C.intake(docs, doc_id="doc_id", text="text")
    table = C.materialize(posteriors(docs, labels, cfg), "posteriors")
    share = np.array([float(weights.get(d, 0.0)) for d in DOMAINS])
    if total_tokens is None:
        total_tokens = table.agg(F.sum("n_tokens")).first()[0] or 0
    targets = share / max(share.sum(), 1e-12) * total_tokens
    rate, got = fit_rates(table, targets, most)
    u = F.coalesce(C.unit_hash(F.col("doc_id"), seed), F.lit(0.0))
    off = [F.lit(float(x)).alias(f"off_{d}") for d, x in zip(DOMAINS, (got - targets) / max(1, total_tokens))]
    return table.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + u).cast("long")).select("*", *off)


def thin(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], seed: str = "mix:", cfg: T.Ftrl = T.Ftrl()) -> DataFrame:
    """Documents with all their columns, mixed to target weights without repeating any: rates go from 0 to 1. The total is
    the largest that needs no less of the first domain than there is, so the mixture has all of that domain, and of each
    other one its weight or, if there are fewer tokens, all of them. Documents likelier of the first domain than not stay
    whatever their rate; the others stay with a chance of their rate, by a seeded hash of the id. Rows with a null id stay."""
    own = "__mix_"
    table = C.materialize(posteriors(docs, labels, cfg, docs.columns, own), "posteriors")
    have = np.array([x or 0.0 for x in table.agg(*[F.sum(F.col(own + "n_tokens") * F.col(f"{own}p_{d}")) for d in DOMAINS]).first()])
    share = np.array([float(weights.get(d, 0.0)) for d in DOMAINS])
    rate, _ = fit_rates(table, np.minimum(have, share / max(share[0], 1e-12) * have[0]), 1.0, prefix=own)
    first, u = F.col(f"{own}p_{DOMAINS[0]}") >= 0.5, C.unit_hash(F.col("doc_id"), seed)
    return table.filter(first | F.col("doc_id").isNull() | (u < rate)).select(*docs.columns)
