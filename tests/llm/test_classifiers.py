from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from backglot.llm import quality, toxicity
from backglot.sources.tables import scan

SF = "/root/testdata/sf0.1"
CASES = {"toxic": (toxicity.op5_toxicity, 0.5, 0.95), "quality": (quality.op7_quality, 0.7, 0.97)}


@pytest.mark.parametrize("label", list(CASES))
def test_held_out_accuracy(spark, label):
    query, threshold, least = CASES[label]
    scored = query(spark, SF)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(scan(spark, SF, "labels"), "doc_id", "left").collect()
    assert len(rows) == scan(spark, SF, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) for r in rows)
    judged = [r for r in rows if r["held_out"] and r[label] is not None]
    assert sum(r["predicted"] == r[label] for r in judged) / len(judged) >= least
    # Clean documents stay clean.
    spared = [r for r in judged if r[label] == (0 if label == "toxic" else 1)]
    assert sum(r["predicted"] == r[label] for r in spared) / len(spared) >= 0.99


def tables(spark, texts, labels, label):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    return docs.select("doc_id", "text"), spark.createDataFrame(labels, f"doc_id long, {label} int")


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
@pytest.mark.parametrize("labels", [[], [(0, 1)], [(0, None), (None, 1)]])
def test_odd_inputs(spark, module, label, labels):
    docs, known = tables(spark, [None, "", "a b c", "word " * 20_000, "a b c"], labels, label)
    model, score = (getattr(module, f"{f}_{'toxicity' if label == 'toxic' else 'quality'}") if f == "score" else getattr(module, f"{'toxicity' if label == 'toxic' else 'quality'}_{f}") for f in ("model", "score"))
    rows = score(docs, model(docs, known, F.lit(True))).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert score(docs.limit(0), model(docs, known, F.lit(True))).collect() == []


def test_label_model_outvotes_a_wrong_label():
    import numpy as np

    draw = np.random.RandomState(1)
    truth = (draw.rand(400) < 0.3).astype(float)
    votes = (draw.rand(400, 12) < np.where(truth[:, None] > 0, 0.6, 0.02)).astype(float)
    given = truth.copy()
    given[:20] = 1 - given[:20]
    found = toxicity.label_model(votes, given)
    assert ((found[:20] >= 0.5) == (truth[:20] > 0)).mean() >= 0.8
    contradicted = (given[:20] == 0) & (votes[:20].sum(1) >= 3)  # where voters abstain nothing contradicts a label
    assert contradicted.sum() >= 3
    assert (found[:20][contradicted] >= 0.5).all()


def plain_label_model(votes, given, trust=0.97, rounds=12):
    """The same estimates, one row and one voter at a time."""
    import math

    n, k = len(votes), len(votes[0])
    posterior = [trust if g > 0.5 else 1 - trust for g in given]
    for _ in range(rounds):
        share = min(max(sum(posterior) / n, 1e-3), 1 - 1e-3)
        weights = [posterior, [1 - p for p in posterior]]
        rates = [[min(max((sum(w[i] * votes[i][j] for i in range(n)) + 0.1) / (sum(w) + 1), 1e-4), 1 - 1e-4) for j in range(k)] for w in weights]
        rest = [[votes[i][j] - posterior[i] * rates[0][j] - (1 - posterior[i]) * rates[1][j] for j in range(k)] for i in range(n)]
        scale = [math.sqrt(sum(rest[i][j] ** 2 for i in range(n))) + 1e-9 for j in range(k)]
        discount = []
        for a in range(k):
            overlaps = [sum(rest[i][a] * rest[i][b] for i in range(n)) / (scale[a] * scale[b]) for b in range(k)]
            discount.append(1 / sum(o for o in overlaps if o > 2 / math.sqrt(n)))
        kept = [min(max(sum(w[i] * g[i] for i in range(n)) / sum(w), 0.6), trust) for w, g in zip(weights, (given, [1 - g for g in given]))]
        out = []
        for i in range(n):
            odds = math.log(share / (1 - share))
            odds += math.log(kept[0] / (1 - kept[1])) if given[i] > 0.5 else math.log((1 - kept[0]) / kept[1])
            for j in range(k):
                r, s = (rates[0][j], rates[1][j]) if votes[i][j] else (1 - rates[0][j], 1 - rates[1][j])
                odds += discount[j] * math.log(r / s)
            out.append(1 / (1 + math.exp(-min(max(odds, -40), 40))))
        posterior = out
    return posterior


def test_label_model_equals_plain_estimates():
    import numpy as np

    draw = np.random.RandomState(3)
    truth = draw.rand(60) < 0.4
    votes = (draw.rand(60, 5) < np.where(truth[:, None], 0.5, 0.1)).astype(float)
    votes[:, 4] = votes[:, 3]  # one voter twice: correlated
    given = np.where(draw.rand(60) < 0.1, ~truth, truth).astype(float)
    want = plain_label_model(votes.tolist(), given.tolist())
    assert toxicity.label_model(votes, given) == pytest.approx(want, abs=1e-9)


def small_rows(seed):
    import numpy as np

    draw = np.random.RandomState(seed)
    y = (draw.rand(80) < 0.5).astype(float)
    found = [sorted(set(draw.randint(0, 30, 6)) | ({40 + draw.randint(4)} if t else {50 + draw.randint(4)})) for t in y]
    return quality.Rows(np.array(sum(found, [])), np.cumsum([0] + [len(f) for f in found])), y, found


def test_log_count_ratios_equal_plain_counts():
    import math

    rows, y, found = small_rows(1)
    got = quality.log_count_ratios(rows, y)
    for feature in range(60):
        good = sum(feature in f for f, t in zip(found, y) if t) + 1
        bad = sum(feature in f for f, t in zip(found, y) if not t) + 1
        assert got[feature] == pytest.approx(math.log(good / (sum(y) + 2)) - math.log(bad / (len(y) - sum(y) + 2)))


def test_dual_descent_reaches_the_hinge_optimum():
    """The gap between the primal and the dual objective closes."""
    import numpy as np

    rows, y, found = small_rows(2)
    scale = quality.log_count_ratios(rows, y)
    weight, bias = quality.dual_descent(rows, scale, y, rounds=400)
    sign = np.where(y > 0.5, 1.0, -1.0)
    limit = np.where(sign > 0, (sign < 0).mean(), (sign > 0).mean()) * 2
    x = np.zeros((len(y), 60))
    for i, f in enumerate(found):
        x[i, f] = scale[f] / np.sqrt(np.dot(scale[f], scale[f]) + 1)
    margin = sign * (x @ weight[:60] + bias)
    norm = 0.5 * (weight @ weight + bias**2)
    primal = norm + (limit * np.maximum(1 - margin, 0)).sum()
    # A lower bound by projected gradient steps on all dual variables at once, with the intercept as one more feature.
    inner = np.column_stack([x, np.ones(len(y))]) * sign[:, None]
    gram = inner @ inner.T
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    dual = np.zeros(len(y))
    for _ in range(20_000):
        dual = np.clip(dual + step * (1 - gram @ dual), 0, limit)
    reached = dual.sum() - 0.5 * dual @ gram @ dual
    assert 0 <= primal - reached + 1e-9 and primal - reached <= 5e-3 * primal


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_labels_and_other_columns_change_nothing(spark, module, label):
    folder = "/root/testdata/sf0.01"
    made = {"toxic": (toxicity.toxicity_model, toxicity.score_toxicity, toxicity.held_out_of(0, 5)), "quality": (quality.quality_model, quality.score_quality, quality.held_out_of(2, 4))}
    model_of, score, held_out = made[label]
    docs, labels = scan(spark, folder, "documents"), scan(spark, folder, "labels")
    model = model_of(docs, labels, ~held_out)
    flipped = labels.withColumn(label, F.when(held_out, 1 - F.col(label)).otherwise(F.col(label)))
    other = model_of(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y"), "score": F.lit("z")}), flipped, ~held_out)
    want = {r["doc_id"]: r["score"] for r in score(docs.select("doc_id", "text"), model).collect()}
    renamed = docs.select((F.col("doc_id") + 10**9).alias("doc_id"), "text", F.lit("q").alias("lang"), F.lit("clash").alias("score"))
    got = score(renamed, other)
    assert got.columns == ["doc_id", "lang", "score"]
    assert {r["doc_id"] - 10**9: r["score"] for r in got.collect()} == want


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_repeated_documents_reach_the_model_once(spark, module, label):
    from backglot.llm import linear

    texts = [(i % 20, f"word{i % 20} " * (i % 7 + 1) if i % 20 else f"t{i}") for i in range(2000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] * 3, f"doc_id long, {label} int")
    rows, y = linear.labelled_sample(docs, labels, label, F.lit(True), 15, linear.word_features)
    assert rows.n == len(y) == 15


def test_scores_at_the_threshold_are_positive(spark, monkeypatch):
    for module, query, threshold in ((toxicity, toxicity.op5_toxicity, 0.5), (quality, quality.op7_quality, 0.7)):
        name = "score_toxicity" if module is toxicity else "score_quality"
        monkeypatch.setattr(module, name, lambda docs, model, t=threshold: docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(t)).otherwise(t - 1e-12).alias("score")))
        rows = query(spark, "/root/testdata/sf0.001").collect()
        assert all(r["predicted"] == (r["doc_id"] % 2 == 0) for r in rows)
