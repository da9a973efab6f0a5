"""Mixing sources to target weights with soft membership, in DataFrame functions only.

A classifier learnt from the labelled table gives every document a posterior over domains: multinomial naive
Bayes over hashed words and hashed word forms, its counts one aggregate over a bounded sample of the labelled rows.
A document's tokens count for each domain by its posterior. Nonnegative document rates are then fitted so
that the expected token totals of the domains match the targets: least squares by projected gradient, where
each step needs one aggregate over the documents for the totals (as many numbers as domains) and moves every
rate by its posterior times the scaled residuals, then back onto the allowed range.

Defined results: a null or empty text has no tokens, the prior's posterior, and is rated like any other;
rows without a domain are never learnt from; targets of domains that the labelled rows lack are left out and
the others scaled up; with nothing to learn from every rate is 1; repeated rows are rated alike; an id with
several labels counts for each; rows with a null id or an id that repeats are rated each for itself; equal
posteriors: the domain first by name; an empty table gives an empty result; further input columns are ignored.
If the fit ends off the targets (they contradict one another or the allowed range), it warns with the residual,
and mixed_totals gives the totals that were reached.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import settled, text_or_empty

#: Buckets of hashed words and of hashed word forms (each run of small letters or of capitals as one sign).
BUCKETS = 2048
#: Words at which a text's evidence counts for half of what it says, and the prior count of a bucket.
HALF_EVIDENCE, ALPHA = 40, 0.2
#: Rates that the projected gradient may change before they are written out, its most steps, and the relative residual at which it ends.
UNROLLED, STEPS, CLOSE = 8, 64, 1e-4
#: The fit also ends when a step leaves more than this share of the squared residuals: the allowed range holds it back.
STALLED = 0.998


def _features(text: Column) -> Column:
    """Bucket numbers of the text's words, lower-cased, and of their forms."""
    def hashed(c: Column, first: int) -> Column:
        return F.transform(F.array_remove(F.split(c, r"\s+"), ""), lambda w: F.pmod(F.hash(w), F.lit(BUCKETS)) + first)

    forms = F.regexp_replace(F.regexp_replace(text, r"\p{Lu}+", "A"), r"\p{Ll}+", "a")
    return F.concat(hashed(F.lower(text), 0), hashed(forms, BUCKETS))


def fit_domains(df: DataFrame, labelled: DataFrame, text_col: str, id_col: str, max_labelled: int = 20_000) -> list:
    """Name, share and log-probabilities of the buckets of each domain. labelled: id, domain; at most max_labelled rows, chosen by a hash of the id.

    What comes to the driver has as many rows as domains times buckets at most.
    """
    sample = labelled.where("id IS NOT NULL AND domain IS NOT NULL").orderBy(F.xxhash64(F.lit(19), "id"), "id").limit(max_labelled)
    seen = settled(df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(sample), "id").select("domain", _features(F.col("text")).alias("x")), "mix-sample")
    shares = {r.domain: r["count"] for r in seen.groupBy("domain").count().orderBy("domain").collect()}
    counts = {d: np.zeros(2 * BUCKETS) for d in shares}
    for r in seen.select("domain", F.explode("x").alias("b")).groupBy("domain", "b").count().collect():
        counts[r.domain][r.b] = r["count"]
    # Words and forms are two independent draws, each with its own total.
    logs = {d: np.concatenate([np.log((part + ALPHA) / (part.sum() + ALPHA * BUCKETS)) for part in c.reshape(2, -1)]) for d, c in counts.items()}
    return [(d, n / sum(shares.values()), logs[d]) for d, n in shares.items()]


def log_posteriors(x: Column, model: list) -> list[Column]:
    """Unscaled log-posteriors, one for each domain of the model: multinomial naive Bayes, of which a longer text's evidence is tempered."""
    tempered = F.lit(float(HALF_EVIDENCE)) / (F.size(x) / F.lit(2.0) + HALF_EVIDENCE)

    def evidence(logs: np.ndarray) -> Column:
        table = F.lit(logs)
        return F.aggregate(x, F.lit(0.0), lambda total, b: total + F.get(table, b))

    return [F.lit(math.log(share)) + evidence(logs) * tempered for _, share, logs in model]


def mix_to_targets(df: DataFrame, labelled: DataFrame, targets: dict[str, float], text_col: str = "text", id_col: str = "doc_id", max_rate: float | None = None, max_labelled: int = 20_000, row_col: str | None = None) -> DataFrame:
    """id_col, n_tokens, domain (most likely), posterior (map), rate, copies (rate, rounded by a hash of the id, or of the text where it is null); row_col, a key of the rows, comes along if given.

    targets: weight of each domain. A target of None leaves the domain its own proportion of what the others leave.
    With max_rate and such a domain, the weights of the others are upper limits: one that holds less keeps its share.
    With max_rate the rates stay below it, and the budget is the largest at which no domain needs more; else the
    budget is all tokens.
    """
    text = text_or_empty(text_col)
    model = fit_domains(df, labelled, text_col, id_col, max_labelled)
    names = [d for d, _, _ in model]
    k = range(len(names))
    hashed = F.pmod(F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(23), text)).otherwise(F.xxhash64(F.lit(23), F.col(id_col))), F.lit(1 << 53)) / float(1 << 53)
    key, key_back = ([F.col(row_col).alias("row")], [F.col("row").alias(row_col)]) if row_col else ([], [])
    carried = ["row"] if row_col else []
    rows = df.select(*key, F.col(id_col).alias("id"), hashed.alias("u"), _features(text).alias("x")).withColumn("n", (F.size("x") / 2).cast("long"))
    if not names:
        return rows.select(*key_back, F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.lit(None).cast("string").alias("domain"), F.create_map().cast("map<string,double>").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    logs = rows.select(*carried, "id", "u", "n", *(c.alias(f"l{i}") for i, c in zip(k, log_posteriors(F.col("x"), model), strict=True)))
    top = F.greatest(*(F.col(f"l{i}") for i in k)) if len(names) > 1 else F.col("l0")
    logs = logs.withColumn("top", top)
    scale = sum((F.exp(F.col(f"l{i}") - F.col("top")) for i in k), F.lit(0.0))
    state = settled(logs.select(*carried, "id", "u", "n", *((F.exp(F.col(f"l{i}") - F.col("top")) / scale).alias(f"p{i}") for i in k)).withColumn("r", F.lit(1.0)), "mix-state")
    moments = state.agg(*(F.coalesce(F.sum(F.col("n") * F.col(f"p{i}")), F.lit(0.0)).alias(f"e{i}") for i in k), *(F.coalesce(F.sum(F.col("n") * F.col(f"p{i}") * F.col(f"p{j}")), F.lit(0.0)).alias(f"h{i}_{j}") for i in k for j in k)).first()
    there = np.array([moments[f"e{i}"] for i in k])
    wanted = _wanted(there, names, targets, max_rate)
    h = np.array([[moments[f"h{i}_{j}"] for j in k] for i in k])
    weight = 1 / np.maximum(np.diag(h), 1e-9)
    step = 1 / max(np.linalg.eigvalsh(np.sqrt(weight)[:, None] * h * np.sqrt(weight)[None, :]).max(), 1e-9)
    rate, unrolled, before = F.col("r"), 0, math.inf
    for _ in range(STEPS):
        totals = state.select("n", rate.alias("r"), *(f"p{i}" for i in k)).agg(*(F.coalesce(F.sum(F.col("n") * F.col(f"p{i}") * F.col("r")), F.lit(0.0)) for i in k)).first()
        residual = np.array(list(totals)) - wanted
        error = float((weight * residual**2).sum())
        off = float(np.abs(residual).max()) / max(wanted.sum(), 1e-9)
        if off <= CLOSE or error > STALLED * before:
            break
        before = error
        move = sum((F.col(f"p{i}") * float(step * weight[i] * residual[i]) for i in k), F.lit(0.0))
        rate = F.greatest(rate - move, F.lit(0.0))
        if max_rate is not None:
            rate = F.least(rate, F.lit(float(max_rate)))
        unrolled += 1
        if unrolled == UNROLLED:
            state, rate, unrolled = settled(state.withColumn("r", rate), "mix-state"), F.col("r"), 0
    if off > 10 * CLOSE:
        warnings.warn(f"the domain totals miss their targets by up to {off:.2%} of all wanted tokens", stacklevel=2)
    out = state.withColumn("r", F.round(rate, 6))
    best = F.greatest(*(F.col(f"p{i}") for i in k)) if len(names) > 1 else F.col("p0")
    domain = F.coalesce(*(F.when(F.col(f"p{i}") == best, F.lit(names[i])) for i in k))
    posterior = F.create_map(*(x for i in k for x in (F.lit(names[i]), F.col(f"p{i}"))))
    # A rate within a thousandth of a whole number is that number: the fit is no finer.
    whole = F.floor(F.col("r") + 1e-3)
    copies = (whole + F.when(F.col("u") < F.col("r") - whole, 1).otherwise(0)).cast("int")
    return out.select(*key_back, F.col("id").alias(id_col), F.col("n").alias("n_tokens"), domain.alias("domain"), posterior.alias("posterior"), F.col("r").alias("rate"), copies.alias("copies"))


def mixed_totals(mixed: DataFrame) -> DataFrame:
    """(domain, tokens_before, tokens, share): expected token totals of the domains in a result of mix_to_targets."""
    rows = mixed.select("n_tokens", "rate", F.explode("posterior").alias("domain", "p"))
    totals = rows.groupBy("domain").agg(F.sum(F.col("n_tokens") * F.col("p")).alias("tokens_before"), F.sum(F.col("n_tokens") * F.col("p") * F.col("rate")).alias("tokens"))
    return totals.crossJoin(F.broadcast(totals.agg(F.sum("tokens").alias("all")))).select("domain", "tokens_before", "tokens", (F.col("tokens") / F.col("all")).alias("share"))  # one row


def _wanted(there: np.ndarray, names: list[str], targets: dict[str, float | None], max_rate: float | None) -> np.ndarray:
    """Token totals to reach, from the totals that are there."""
    fixed = np.array([float(targets.get(d) or 0.0) if targets.get(d, 0.0) is not None else np.nan for d in names])
    free = np.isnan(fixed)
    if max_rate is not None and free.any():
        # Domains within their limits are free too; binding one leaves the others more, which may bind another.
        limits, bound = np.where(free, np.inf, fixed), np.zeros(len(fixed), bool)
        while True:
            share = max(1.0 - limits[bound].sum(), 0.0) * there / max(there[~bound].sum(), 1e-9)
            over = ~bound & (share > limits * (1 + 1e-9))
            if not over.any():
                break
            bound |= over
        free = ~bound
        fixed = np.where(bound, limits, np.nan)
    given = np.nansum(fixed)
    if free.any():
        left = max(1.0 - given, 0.0)
        fixed[free] = left * there[free] / max(there[free].sum(), 1e-9)
    share = fixed / max(fixed.sum(), 1e-9)
    budget = there.sum()
    if max_rate is not None:
        used = share > 0
        budget = min(budget * max_rate, (max_rate * there[used] / share[used]).min()) if used.any() else 0.0
    return share * budget


def quality_domains(labels: DataFrame, docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", quality_col: str = "quality") -> DataFrame:
    """(id, domain) of the labelled rows: `low` where quality is 0, else the row's language."""
    langs = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
    marked = labels.select(F.col(id_col).alias("id"), F.col(quality_col).alias("q")).where("q IS NOT NULL")
    return marked.join(langs, "id").select("id", F.when(F.col("q") == 0, F.lit("low")).otherwise(F.col("lang")).alias("domain"))
