"""Classifiers on distributed features, and active learning."""

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowloom.functions import numeric
from flowloom.operators import graphs, metrics
from flowloom.operators.neighbours import knn_extend
from flowloom.operators.ordering import top_n
from flowloom.operators.sampling import balanced_weights, class_counts, exact_n, fixed_weights, per_class, replicate
from flowloom.sources import scratch

# Hidden layer widths of the dense classifier.
DENSE_HIDDEN = [320, 192, 96, 48]
# Training weights of benign and attack rows on the graph.
GRAPH_WEIGHTS = {0: 1.0, 1: 4.0}


def budgets(n, initial=0.05, per_round=0.02):
    """Row counts of the first labelled set and of each query round."""
    return int(n * initial), int(n * per_round)


def initial_labels(df, key, budget, label="label", seed=42):
    """Keys of a stratified first labelled set; random when a class is missing."""
    counts = class_counts(df, label)
    benign, attack, total = counts.get(0, 0), counts.get(1, 0), sum(counts.values())
    if not benign or not attack:
        return exact_n(df, key, min(budget, total), (), seed).select(key)
    want = int(budget * (benign / total))
    sizes = {0: min(want, benign), 1: min(budget - want, attack)}
    return exact_n(df, key, per_class(label, sizes), (label,), seed).select(key)


def uncertainty(df, strategy="entropy", key=None, prob="prob", seed=42):
    """Adds ``score``: how unsure a row's attack probability is."""
    from flowloom.functions.hashing import uniform

    p = F.col(prob)
    if strategy == "random":
        return df.withColumn("score", uniform(key, seed))
    rule = {"entropy": numeric.entropy, "margin": numeric.margin}[strategy]
    return df.withColumn("score", rule([1 - p, p]))


def query(scored, labeled, key, n, strategy="entropy", prob="prob", seed=42):
    """Keys of the n least certain rows outside the labelled set."""
    pool = scored.join(labeled.select(key), key, "left_anti")
    return top_n(uncertainty(pool, strategy, key, prob, seed), "score", n, key).select(key)


def _assembler(columns):
    return VectorAssembler(inputCols=list(columns), outputCol="_vector")


def fit_graph_classifier(rows, columns, label="label", weights=None, max_iter=50):
    """Weighted logistic regression on propagated features."""
    weighted = fixed_weights(rows, weights or GRAPH_WEIGHTS, label, "_weight")
    model = LogisticRegression(
        featuresCol="_vector", labelCol=label, weightCol="_weight", maxIter=max_iter, regParam=5e-4,
        tol=1e-4,
    )
    return Pipeline(stages=[_assembler(columns), model]).fit(weighted)


def fit_dense(rows, columns, label="label", max_iter=60, seed=42, key=None, weights=None):
    """Feed-forward classifier over the four hidden layers.

    The learner knows no weights: with ``weights`` ({class: weight}, or ``"balanced"``)
    rows are replicated by them first, for which ``key`` must tell rows apart.
    """
    if weights:
        weights = balanced_weights(rows, label) if weights == "balanced" else weights
        rows = replicate(rows, key, weights, label, seed, "_copy").drop("_copy")
    model = MultilayerPerceptronClassifier(
        featuresCol="_vector", labelCol=label, layers=[len(columns), *DENSE_HIDDEN, 2],
        maxIter=max_iter, seed=seed,
    )
    return Pipeline(stages=[_assembler(columns), model]).fit(rows)


def sequence_features(df, width, steps="steps"):
    """Mean, largest and last value per feature over a sequence's steps."""

    def column(i):
        return F.transform(steps, lambda x: x[i])

    out = {}
    for i in range(width):
        values = column(i)
        out[f"mean_{i}"] = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(steps)
        out[f"max_{i}"] = F.array_max(values)
        out[f"last_{i}"] = F.element_at(values, -1)
    return df.withColumns(out), list(out)


def fit_sequence(rows, columns, label="label", weight=None, max_iter=20, seed=42):
    """Gradient-boosted trees on sequence features."""
    model = GBTClassifier(
        featuresCol="_vector", labelCol=label, maxIter=max_iter, maxDepth=4, seed=seed
    )
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[_assembler(columns), model]).fit(rows)


def score(model, df, threshold=0.5, inclusive=False):
    """Adds ``prob`` and ``y_pred``; offline ``>``, online (inclusive) ``>=``."""
    kept = df.columns
    scored = model.transform(df).withColumn("prob", vector_to_array("probability")[1])
    p = F.col("prob")
    hit = p >= threshold if inclusive else p > threshold
    return scored.withColumn("y_pred", F.when(hit, 1).otherwise(0)).select(*kept, "prob", "y_pred")


def evaluate(scored, label="label"):
    """(tn, fp, fn, tp, rates, auc) in one row; the scored rows are made once."""
    scored = scratch.materialise(scored.select(label, "prob", "y_pred"), "scored")
    rows = metrics.scores(metrics.confusion(scored, (), label)).first().asDict()
    rows["auc"] = metrics.auc(scored, label).first()["auc"]
    return rows


def smooth(nodes, labeled, key, columns, k=10, hops=3, edges="labeled", links=None):
    """Propagated features of every row over the nearest-neighbour graph.

    With labelled-only edges the other rows have none and keep their own
    features, so only the labelled part is searched and propagated. ``links`` are the
    edges when they are known already.
    """
    vector = nodes.withColumn("_x", F.array(*columns))
    if edges == "all":
        pool, rest = vector, None
    else:
        pool = vector.join(labeled.select(key), key, "left_semi")
        rest = nodes.join(labeled.select(key), key, "left_anti")
    if links is None:
        links = scratch.materialise(graphs.knn_edges(pool, key, "_x", k), "edges")
    out = graphs.propagate(pool.drop("_x"), links, key, columns, hops)
    return out if rest is None else out.unionByName(rest.select(*out.columns))


def active_learning(
    df, key, columns, label="label", k=10, initial=0.05, per_round=0.02, rounds=10, hops=3,
    strategy="entropy", edges="labeled", seed=42,
):
    """One history row per round of graph, training, evaluation and query.

    The last round does not query. Labelled keys, edges and scores are written tables,
    so a round's plan does not grow with the rounds before it. A round compares the new
    labelled rows with all labelled ones and merges lists; pairs that were compared in a
    round before are not compared again.
    """
    spark = df.sparkSession
    nodes = scratch.materialise(df.select(key, F.col(label).alias("label"), *columns), "al")
    n = nodes.count()
    first, more = budgets(n, initial, per_round)
    labeled = scratch.materialise(initial_labels(nodes, key, first, "label", seed), "al")
    vector = nodes.select(key, F.array(*columns).alias("_x"))
    rows = lambda keys: vector.join(keys.select(key), key, "left_semi")
    history, links, known, chosen = [], None, None, labeled
    for turn in range(1, rounds + 1):
        following, linked, asked = (scratch.new_path(spark, "al") for _ in range(3))
        with scratch.temporary(spark):
            if links is None or edges == "all":
                links = links or scratch.materialise(graphs.knn_edges(vector if edges == "all" else rows(labeled), key, "_x", k), path=linked)
            else:
                links = scratch.materialise(knn_extend(links, rows(known), rows(chosen), key, "_x", k), path=linked)
            count = labeled.count()
            if edges == "all":
                features = scratch.materialise(smooth(nodes, labeled, key, columns, k, hops, edges, links), "al")
                train, test = (features.join(labeled, key, how) for how in ("left_semi", "left_anti"))
            else:
                # Other rows keep their own features, so only the labelled ones are written.
                pool, test = (nodes.join(labeled, key, how) for how in ("left_semi", "left_anti"))
                train = scratch.materialise(graphs.propagate(pool, links, key, columns, hops), "al")
            model = fit_graph_classifier(train, columns)
            test = score(model, test)
            scored = scratch.materialise(test.select(key, "label", "prob", "y_pred"), "al")
            result = evaluate(scored)
            history.append(
                (turn, count, count * 100.0 / n, result["accuracy"], result["f1"], result["auc"])
            )
            if turn < rounds:
                known = labeled
                chosen = scratch.materialise(query(scored, labeled, key, more, strategy, "prob", seed + turn), path=asked)
                labeled = scratch.materialise(labeled.unionByName(chosen), path=following)
    return spark.createDataFrame(
        history,
        "round int, labeled_count long, labeled_percent double, test_acc double, test_f1 double, test_auc double",
    )


class FoldModels:
    """One linear model per held-out fold: ``coefficients`` has a row per fold, the last value the intercept."""

    def __init__(self, columns, fold, coefficients):
        self.columns, self.fold, self.coefficients = list(columns), fold, coefficients

    def score(self, df, threshold=0.5):
        """Adds ``prob`` and ``y_pred`` by the model that never saw the row's fold."""
        x = F.array(*[F.col(c).cast("double") for c in self.columns], F.lit(1.0))
        own = F.lit(None).cast("array<double>")
        for f, row in enumerate(self.coefficients.tolist()):
            own = F.when(F.col(self.fold) == f, F.array(*[F.lit(v) for v in row])).otherwise(own)
        total = F.aggregate(F.zip_with(x, own, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        scored = df.withColumn("prob", 1 / (1 + F.exp(-total)))
        return scored.withColumn("y_pred", F.when(F.col("prob") > threshold, 1).otherwise(0))


def fit_folds(df, columns, label="label", fold="fold", k=5, weights=None, reg=5e-4, max_iter=30, tol=1e-9):
    """k weighted logistic regressions at once, each without one fold; the penalty is on scaled features.

    Newton steps: each is one Spark job over all rows, in which every task sums the
    gradients and curvatures of all folds' models over its rows, a few numbers per
    fold and pair of features. A fold whose loss would rise halves its step.
    """
    rows = fixed_weights(df, weights or GRAPH_WEIGHTS, label, "_w")
    rows = rows.select(F.col(fold).cast("int").alias("_f"), F.col(label).cast("double").alias("_y"), "_w", F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))
    rows = scratch.materialise(rows.filter(F.col("_f").between(0, k - 1) & F.col("_y").isNotNull()), "fold-rows")
    d = len(columns)
    square = np.zeros((k, d))

    def sums(beta):
        def run(batches):
            got = np.zeros((k, size))
            for part in batches:
                x = np.column_stack([np.stack(part["_x"].to_numpy()), np.ones(len(part))]) if len(part) else np.zeros((0, d + 1))
                y, w, own = part["_y"].to_numpy(), part["_w"].to_numpy(), part["_f"].to_numpy()
                for f in range(k):
                    m = np.where(own == f, 0.0, w)
                    if beta is None:
                        got[f] += np.concatenate([[m.sum()], m @ x[:, :d], m @ (x[:, :d] ** 2)])
                        continue
                    z = x @ beta[f]
                    p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
                    loss = (m * (np.logaddexp(0.0, z) - y * z)).sum()
                    curve = (x * (m * p * (1 - p))[:, None]).T @ x
                    got[f] += np.concatenate([[loss], x.T @ (m * (p - y)), curve.ravel()])
            yield pd.DataFrame({"f": range(k), "v": list(got)})

        size = 1 + 2 * d if beta is None else 1 + (d + 1) + (d + 1) ** 2
        parts = rows.mapInPandas(run, "f int, v array<double>")
        # A task gives one row per fold; values are added place by place.
        spread = parts.select("f", F.posexplode("v").alias("i", "v")).groupBy("f", "i").agg(F.sum("v").alias("v"))
        total = np.zeros((k, size))
        for r in spread.collect():
            total[r["f"], r["i"]] = r["v"]
        return total

    moments = sums(None)
    weight = np.maximum(moments[:, 0], 1e-300)
    mean = moments[:, 1 : d + 1] / weight[:, None]
    square = np.maximum(moments[:, d + 1 :] / weight[:, None] - mean**2, 0.0)
    penalty = np.column_stack([reg * square, np.zeros(k)])

    def objective(total, beta):
        return total[:, 0] / weight + 0.5 * (penalty * beta**2).sum(1)

    beta = np.zeros((k, d + 1))
    at = sums(beta)
    step, moved = np.ones(k), np.zeros((k, d + 1))
    for _ in range(max_iter):
        for f in range(k):
            gradient = at[f, 1 : d + 2] / weight[f] + penalty[f] * beta[f]
            curve = at[f, d + 2 :].reshape(d + 1, d + 1) / weight[f] + np.diag(penalty[f] + 1e-12)
            moved[f] = np.linalg.lstsq(curve, -gradient, rcond=None)[0]
        step[:] = 1.0
        while True:
            trial = beta + step[:, None] * moved
            ahead = sums(trial)
            worse = objective(ahead, trial) > objective(at, beta) + 1e-12
            if not worse.any() or step.min() < 1e-6:
                break
            step[worse] /= 2
        gain = objective(at, beta) - objective(ahead, trial)
        keep = gain >= -1e-12
        beta, at = np.where(keep[:, None], trial, beta), np.where(keep[:, None], ahead, at)
        if (gain[keep] < tol).all():
            break
    return FoldModels(columns, fold, beta)


def cross_validate(df, fit, label="label", fold="fold", k=5, threshold=0.5):
    """One metrics row per fold; ``fit(train)`` returns a model. Folds are fitted one after the other."""
    spark = df.sparkSession
    rows = []
    for f in range(k):
        model = fit(df.filter(F.col(fold) != f))
        result = evaluate(score(model, df.filter(F.col(fold) == f), threshold), label)
        rows.append((f, *[result[c] for c in _FOLD_COLUMNS]))
    kinds = ["long"] * 4 + ["double"] * (len(_FOLD_COLUMNS) - 4)
    schema = ", ".join(f"{c} {t}" for c, t in zip(_FOLD_COLUMNS, kinds))
    return spark.createDataFrame(rows, f"fold int, {schema}")


def cross_validate_together(df, columns, label="label", fold="fold", k=5, threshold=0.5, weights=None):
    """The same metrics from ``fit_folds``: all folds are trained, scored and measured together."""
    models = fit_folds(df, columns, label, fold, k, weights)
    scored = models.score(df.filter(F.col(fold).between(0, k - 1)), threshold)
    scored = scratch.materialise(scored.select(F.col(fold).cast("int").alias("fold"), label, "prob", "y_pred"), "scored")
    rates = metrics.scores(metrics.confusion(scored, "fold", label))
    areas = None
    for f in range(k):
        area = metrics.auc(scored.filter(F.col("fold") == f), label).withColumn("fold", F.lit(f))
        areas = area if areas is None else areas.unionByName(area)
    return rates.join(areas, "fold").select("fold", *_FOLD_COLUMNS)


_FOLD_COLUMNS = [
    "tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1", "specificity", "auc",
]
