"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

* Voters. Lexicon voters are words, pattern voters are beginnings of words (so inflected forms count as one).
  They are drawn from a bounded sample of labelled rows: what occurs in toxic rows far more often than by chance.
  A voter votes "toxic" where its word or pattern occurs and abstains elsewhere.
* Label model. With the class hidden, every voter has a rate of votes in either class (its accuracy). EM estimates
  these rates and the share of toxic rows; correlations that remain within the classes discount voters that
  repeat each other. The result is a posterior label for every row of the sample.
* Classifier. Logistic regression on hashed words and beginnings, trained on the posterior labels, scores all rows.

Defined results for odd inputs: null and empty texts have no features and get the bare intercept's score; without a
usable label of either class every score is the share of toxic labels (0 without labels); repeated rows get repeated
results; an empty table gives an empty result; lang, source and other columns are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.llm import linear
from backglot.llm.linear import BITS, Rows, sigmoid
from backglot.sources.tables import scan

SAMPLE_ROWS = 10_000  # labelled rows that the model is fitted on
VOTERS = 300  # most voters that are drawn
VOTER_SUPPORT = 3  # toxic rows a voter must occur in
VOTER_PRECISION = 0.7  # smoothed share of toxic rows among those it occurs in


def draw_voters(rows: Rows, y: np.ndarray) -> np.ndarray:
    """Numbers of the features that vote, best first."""
    toxic, clean = rows.counts(y), rows.counts(1 - y)
    share = (toxic + 0.5) / (toxic + clean + 1)
    good = np.flatnonzero((toxic >= VOTER_SUPPORT) & (share >= VOTER_PRECISION))
    gain = toxic[good] * np.log(share[good] / max(y.mean(), 1e-6))
    return good[np.argsort(-gain, kind="stable")][:VOTERS]


def label_model(votes: np.ndarray, given: np.ndarray, trust: float = 0.97, rounds: int = 12) -> np.ndarray:
    """Posterior of the hidden class per row of ``votes`` (rows x voters, 0 or 1).

    Per class each voter has a rate at which it votes, so both its vote and its silence are evidence; what correlated voters
    say beyond their class is discounted. The label ``given`` with a row is a voter too: it ties the hidden class to
    what labels mean. Its accuracy is estimated in each class, up to ``trust``.
    """
    votes = votes.astype(float)
    posterior = np.where(given > 0.5, trust, 1 - trust)
    for _ in range(rounds):
        share = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
        rates = []
        for weight in (posterior, 1 - posterior):
            rates.append(np.clip((weight @ votes + 0.1) / (weight.sum() + 1), 1e-4, 1 - 1e-4))
        rest = votes - np.outer(posterior, rates[0]) - np.outer(1 - posterior, rates[1])
        scale = np.sqrt((rest**2).sum(0)) + 1e-9
        overlap = (rest.T @ rest) / np.outer(scale, scale)
        discount = 1 / np.where(overlap > 2 / np.sqrt(len(votes)), overlap, 0).sum(1)  # less is chance
        evidence = np.log(rates[0] / rates[1]) * discount
        silence = np.log((1 - rates[0]) / (1 - rates[1])) * discount
        kept = [np.clip(w @ g / w.sum(), 0.6, trust) for w, g in ((posterior, given), (1 - posterior, 1 - given))]
        tie = np.where(given > 0.5, np.log(kept[0] / (1 - kept[1])), np.log((1 - kept[0]) / kept[1]))
        posterior = sigmoid(np.log(share / (1 - share)) + votes @ (evidence - silence) + silence.sum() + tie)
    return posterior


def train_logistic(rows: Rows, target: np.ndarray, rounds: int = 400, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept for soft targets, by gradient steps scaled per feature (Adagrad)."""
    weight, bias = np.zeros(1 << BITS), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    seen, seen_bias = np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(rounds):
        error = (sigmoid(rows.dot(weight) + bias) - target) / rows.n
        step = rows.counts(error) + decay / rows.n * weight
        seen += step**2
        seen_bias += error.sum() ** 2
        weight -= 0.2 * step / np.sqrt(seen)
        bias -= 0.2 * error.sum() / np.sqrt(seen_bias)
    return weight, bias


def fit(rows: Rows, y: np.ndarray) -> dict:
    """Model of a sample: weights by feature number, an intercept, and which features count."""
    flat = {"keep": np.zeros(1 << BITS, bool), "weight": np.zeros(1), "bias": -40.0}
    if len(y) == 0 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.0, 1e-12, 1 - 1e-12)
        return flat | {"bias": float(np.log(share / (1 - share)))}
    voters = draw_voters(rows, y)
    votes = np.zeros((rows.n, len(voters)))
    column = np.full(1 << BITS, -1)
    column[voters] = np.arange(len(voters))
    hit = column[rows.found] >= 0
    votes[rows.owner[hit], column[rows.found[hit]]] = 1
    posterior = label_model(votes, y)
    # Features whose share among toxic rows is no accident; rare ones carry only noise into long texts.
    toxic, every = rows.counts(posterior), rows.counts(np.ones(rows.n))
    expected = every * posterior.mean()
    keep = (every >= 3) & (np.abs(toxic - expected) > 3 * np.sqrt(expected + 0.3)) & (toxic > 0.5 * every)
    chosen = rows.only(keep)
    weight, bias = train_logistic(chosen, posterior)
    return {"keep": keep, "weight": weight.astype(np.float32), "bias": bias}


def _score(n: int, owner: np.ndarray, found: np.ndarray, model: dict) -> np.ndarray:
    if not len(found):
        return np.full(n, sigmoid(np.float64(model["bias"])))
    return sigmoid(np.bincount(owner, model["weight"][found], n) + model["bias"])


def toxicity_model(docs: DataFrame, labels: DataFrame, usable, rows: int = SAMPLE_ROWS) -> dict:
    """Fitted on at most ``rows`` labelled documents that satisfy ``usable``."""
    return fit(*linear.labelled_sample(docs, labels, "toxic", usable, rows, linear.word_features))


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` without ``text``, with ``score`` (0 to 1; higher: likelier toxic)."""
    return linear.apply_scores(docs, linear.word_features, _score, model)


def held_out_of(fold: int, folds: int):
    """Whether the crc32 of the id as text falls into the fold that no model may learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = scan(spark, folder, "documents"), scan(spark, folder, "labels")
    held_out = held_out_of(0, 5)
    scored = score_toxicity(docs.select("doc_id", "text"), toxicity_model(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
