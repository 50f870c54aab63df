"""Mixing documents to target weights of domains, with soft membership.

A classifier learned from a table of labelled documents (multinomial naive Bayes over hashed words) gives each
document a posterior over domains. Naive Bayes is too sure of itself, as words aren't independent; so log
likelihoods are divided by a power of the number of words and scaled, both chosen by the likelihood of labelled
documents that were held out. Nonnegative rates, one a document, are then fitted so that the expected tokens of each
domain match the targets: least squares by projected gradient. The residual has one number a domain; a step moves
every rate by the posterior times the residual (scaled by the inverse of the domains' second moments over the rates
that aren't cut) and cuts it at zero. Rates are a function of the posterior, rounded to a cell of a grid, and the residuals so far; expected tokens
are added up by cell from the exact posteriors once, a step is one scan of these sums that gives as many numbers as
there are domains, and nothing of a document ever leaves the executors.

DataFrame functions only; the driver solves systems of the size of the number of domains.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, release, stored

BUCKETS = 1 << 13
GRID = 1024  # cells of posteriors: rates are alike where these round alike
SAMPLE = 20_000  # labelled documents to learn from at most, about; chosen by a hash of doc_id
HELD = 5  # one labelled document in so many is held out, for calibration
POWERS, SCALES = (0.0, 0.5, 1.0), tuple(2.0**k for k in range(-8, 11))  # what calibration chooses from
#: Letters, digits and other signs as byte-pair vocabularies cut them first: what is counted as a token.
TOKEN = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(word)), F.lit(BUCKETS)).cast("int")


def constants(values: list[float]) -> Column:
    """An array of doubles as one constant, however long."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def sampled(labelled: DataFrame, domains: list[str], sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(to learn from, held out) of `labelled` (doc_id, text, domain); about `sample` rows at most, by a hash of doc_id."""
    labelled = labelled.where(F.col("domain").isin(domains) & F.col("text").isNotNull())
    if (classes := -(-labelled.select("doc_id").count() // sample)) > 1:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(classes)) == 0)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(HELD)) == 0
    return labelled.where(~fold), labelled.where(fold)


def learn(labelled: DataFrame, domains: list[str]) -> list[list[float]]:
    """Log probabilities by domain and bucket, prior added in a last place, from `labelled` (text, domain).

    To the driver come buckets times domains counts at most. A domain without documents has prior one.
    """
    words = labelled.select("domain", F.explode(F.array_distinct(F.transform(words_of(F.col("text")), bucket))).alias("bucket"))
    docs = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = {d: [0.5] * BUCKETS for d in domains}
    for r in words.groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["domain"]][r["bucket"]] += r["n"]
    total, sums = sum(docs.values()) + len(domains), {d: sum(counts[d]) for d in domains}
    return [[math.log(c / sums[d]) for c in counts[d]] + [math.log((docs.get(d, 0) + 1) / total)] for d in domains]


def scored(docs: DataFrame, logs: list[list[float]]) -> DataFrame:
    """`docs` with n_tokens, n_buckets and scores (log likelihood by domain) in place of text; a text counts each bucket once."""
    rows = docs.withColumns({"n_tokens": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKEN)).cast("long"), "buckets": F.array_distinct(F.transform(words_of(F.col("text")), bucket))}).drop("text")

    def score(own: list[float]) -> Column:
        table = constants(own[:-1])
        return F.aggregate("buckets", F.lit(0.0), lambda a, i: a + F.element_at(table, i + 1))

    return rows.withColumn("n_buckets", F.size("buckets")).withColumn("scores", F.array(*map(score, logs))).drop("buckets")


def weighed(logs: list[list[float]], power: Column, scale: Column) -> Column:
    """Log posterior by domain, up to a constant, from scores and n_buckets."""
    own = scale / F.pow(F.greatest("n_buckets", F.lit(1)).cast("double"), power)
    return F.array(*(F.col("scores")[k] * own + F.lit(prior[-1]) for k, prior in enumerate(logs)))


def exponentials(z: Column) -> Column:
    """Of each value, the largest first brought to zero."""
    return F.transform(z, lambda x: F.exp(F.greatest(x - F.array_max(z), F.lit(-700.0))))


def total_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def calibrate(held: DataFrame, domains: list[str], logs: list[list[float]]) -> tuple[float, float]:
    """(power, scale) under which the domains of `held` (text, domain) are likeliest; (0, 1), plain naive Bayes, without rows."""
    choices = F.array(*(F.struct(F.lit(p).alias("power"), F.lit(s).alias("scale")) for p in POWERS for s in SCALES))
    at = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("int").alias("at")
    rows = stored(scored(held.select("text", "domain"), logs).where("n_buckets > 0").select("n_buckets", "scores", at), "held")
    each = rows.select("n_buckets", "scores", "at", F.explode(choices).alias("c")).select("at", "c.power", "c.scale", weighed(logs, F.col("c.power"), F.col("c.scale")).alias("z"))
    loss = F.array_max("z") + F.log(total_of(exponentials(F.col("z")))) - F.element_at("z", F.col("at"))
    losses = each.groupBy("power", "scale").agg(F.sum(loss).alias("loss")).collect()
    release(rows)
    best = min(((r["loss"], r["power"], r["scale"]) for r in losses), default=(0, 0.0, 1.0))
    return best[1], best[2]


def posteriors(docs: DataFrame, logs: list[list[float]], power: float = 0.0, scale: float = 1.0) -> DataFrame:
    """`docs` with n_tokens, p (array, a posterior for each domain) and cell (p in multiples of 1 / GRID) in place of text.

    Texts without words have the prior.
    """
    rows = scored(docs, logs).withColumn("z", weighed(logs, F.lit(power), F.lit(scale)))
    rows = rows.withColumn("odds", exponentials(F.col("z"))).withColumn("whole_odds", total_of(F.col("odds")))
    rows = rows.withColumn("p", F.transform("odds", lambda o: o / F.col("whole_odds")))
    cell = F.transform("p", lambda x: F.round(x * GRID).cast("int")).alias("cell")
    return rows.select("*", cell).select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], once(F.struct("n_tokens", "p", "cell"), "own")).select("*", "own.*").drop("own")


def fit_rates(rows: DataFrame, weights: list[float], growth: float = 1.0, anchor: int | None = None, steps: int = 60, tolerance: float = 1e-6) -> tuple[Column, float]:
    """(rate of a row as a column, residual) of `rows` (n_tokens, p, cell), so that expected tokens by domain match `weights`.

    Weights are scaled to add up to one. Without tokens every rate is one. Rates start at `growth`, and the expected
    tokens of all rows shall be so many times what they are. No rate falls below zero; with `anchor`, none of a row
    whose likeliest domain that is falls below one, so none of them is lost. The residual is the largest difference
    between a domain's share and its weight after the best step; where the targets can't be met the fit is the nearest
    that was reached before five steps brought it down by less than 2 % each.
    """
    k, tokens = len(weights), F.col("n_tokens").cast("double")
    names = [f"e{i}" for i in range(k)]
    cells = stored(rows.groupBy("cell").agg(*(F.sum(tokens * F.col("p")[i]).alias(e) for i, e in enumerate(names))), "cells")  # a rate depends on the cell alone
    at = [F.col("cell")[i] / F.lit(float(GRID)) for i in range(k)]
    total, target = sum(cells.agg(*(F.coalesce(F.sum(e), F.lit(0.0)) for e in names)).first()), np.array(weights) / sum(weights)
    if not total:
        release(cells)
        return F.lit(1.0), 0.0
    likeliest = F.array_position("cell", F.array_max("cell")) - 1
    least = F.when(likeliest == anchor, 1.0).otherwise(0.0) if anchor is not None else F.lit(0.0)

    def after(moves: list[list[float]]) -> Column:
        """The rate once it has been moved and cut so often."""
        if not moves:
            return F.lit(float(growth))
        flat = constants([x for v in moves for x in v])
        step = lambda r, t: F.greatest(least, r - sum((at[i] * F.element_at(flat, t * k + i + 1) for i in range(k)), F.lit(0.0)))
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(moves) - 1)), F.lit(float(growth)), step)

    moves, best, reached = [], [], float("inf")
    while True:
        now = cells.select(*names, *(x.alias(f"p{i}") for i, x in enumerate(at)), after(moves).alias("rate"), least.alias("least"))
        free = (F.col("rate") > F.col("least")).cast("double")
        sums = np.array(now.agg(*(F.sum(F.col("rate") * F.col(e)) for e in names), *(F.sum(free * F.col(e) * F.col(f"p{i}")) for e in names for i in range(k))).first(), float) / (growth * total)
        off = sums[:k] - target
        if np.abs(off).max() < 0.98 * reached or len(moves) < 3:
            if np.abs(off).max() < reached:
                best, reached, since = list(moves), float(np.abs(off).max()), 0
        else:
            since += 1
        if reached < tolerance or since == 5 or len(moves) == steps:
            break
        moves.append([float(x) for x in np.linalg.pinv(sums[k:].reshape(k, k), rcond=1e-9) @ off])
    rate, residual = after(best), reached
    release(cells)
    return rate, residual


def model(labelled: DataFrame, domains: list[str]) -> tuple[list[list[float]], float, float]:
    """(log probabilities, power, scale) from `labelled` (doc_id, text, domain)."""
    some, held = sampled(labelled, domains)
    logs = learn(some, domains)
    return logs, *calibrate(held, domains, logs)


def copied(rows: DataFrame, rate: Column, seed: int) -> DataFrame:
    """`rows` (doc_id, row_tie, cell) with rate and copies."""
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "row_tie"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("rate", rate)
    return rows.withColumn("copies", (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_tie"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], growth: float = 1.0, anchor: str | None = None, seed: int = 0) -> DataFrame:
    """doc_id, row_tie, n_tokens, p, cell, rate, copies, residual for each row of `docs` (doc_id, text).

    copies: the rate's whole part, and one more where a hash of doc_id and text falls below its fraction, so rows
    are decided alone and always alike. Repeated rows get the same copies. Null and empty texts have no tokens and
    the prior. residual is that of fit_rates(). Tokens are letters' and signs' runs and single digits, as byte-pair
    vocabularies cut them first. Other columns of `docs` are not read; texts of any length are read whole.
    """
    domains = sorted(targets)
    logs, power, scale = model(labelled, domains)
    rows = stored(posteriors(keyed(docs), logs, power, scale), "posteriors")
    rate, residual = fit_rates(rows, [targets[d] for d in domains], growth, domains.index(anchor) if anchor else None)
    return copied(rows, rate, seed).withColumn("residual", F.lit(residual))


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, domain (toxic, low, high) of documents that `labels` (doc_id, quality, toxic) covers; nulls don't label."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high")
    known = labels.select("doc_id", domain.alias("domain")).where("domain is not null and doc_id is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    return docs.select("doc_id", "text").join(known, "doc_id")


#: Shares of expected tokens that a mix should have, and how much of the corpus it should be: far from the corpus, which
#: has about 82, 9 and 9 %, so many rates fall to zero.
TARGETS, GROWTH = {"high": 0.60, "low": 0.25, "toxic": 0.15}, 1.0
#: What the pipeline asks for instead: no document likeliest of good quality (the anchor) is lost, others about as often.
KEPT_TARGETS, ANCHOR, KEPT_GROWTH = {"high": 0.85, "low": 0.07, "toxic": 0.08}, "high", 1.25


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = KEPT_TARGETS, seed: int = 0, growth: float = KEPT_GROWTH, anchor: str | None = ANCHOR) -> DataFrame:
    """The rows of `docs`, with all columns whatever their names, as often as their copies say.

    Null and empty texts, repeated rows and null doc_ids as in mix(); no rows give no rows. Posteriors are computed
    again with the rows, so no text is shuffled.
    """
    domains = sorted(targets)
    logs, power, scale = model(labelled_documents(docs, labels), domains)
    cells = stored(posteriors(keyed(docs), logs, power, scale).select("n_tokens", "p", "cell"), "posteriors")
    rate, _ = fit_rates(cells, [targets[d] for d in domains], growth, domains.index(anchor) if anchor in domains else None)
    release(cells)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_tie"))
    rows = copied(posteriors(rows, logs, power, scale), rate, seed).where("copies > 0")
    return rows.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole.*")
