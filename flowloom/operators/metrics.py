"""Class distributions, binary-classification metrics and result tables.

Scored rows carry ``y_true``, ``prob`` and ``y_pred``. Anything that needs an
order of scores works on counts per distinct score, in range partitions: scores
are compared as they are and there may be as many as rows.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom.functions.numeric import ratio
from flowloom.operators.ordering import previous, running_totals


def class_distribution(df, label="label", by=()):
    """(by..., label, n, percent): counts and shares per set."""
    by = [by] if isinstance(by, str) else list(by)
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("percent", F.col("n") * 100.0 / total)


def balance_check(df, label="label", target=0.70, tolerance=0.05):
    """(benign, total, benign_share, balanced) in one row."""
    counts = df.agg(
        F.count_if(F.col(label) == 0).alias("benign"), F.count(F.lit(1)).alias("total")
    )
    share = F.try_divide(F.col("benign").cast("double"), F.col("total"))
    return counts.withColumn("benign_share", share).withColumn(
        "balanced", F.abs(F.col("benign_share") - target) <= tolerance
    )


def feature_statistics(df, columns):
    """(feature, n, mean, var_pop, min, max), one pass for all columns."""
    stats = df.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.var_pop(c).alias("var_pop"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
            ).alias(f"f{i}")
            for i, c in enumerate(columns)
        ]
    )
    each = F.explode(F.array(*[f"f{i}" for i in range(len(columns))])).alias("e")
    return stats.select(each).select("e.*")


def confusion(df, by=(), truth="y_true", pred="y_pred"):
    """(by..., tn, fp, fn, tp) from one conditional count pass."""
    by = [by] if isinstance(by, str) else list(by)

    def cell(t, p):
        return F.count_if((F.col(truth) == t) & (F.col(pred) == p))

    return df.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def confusion_long(df, truth="y_true", pred="y_pred"):
    """(y_true, y_pred, n, share) with shares inside each true class."""
    counts = df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(truth))
    return counts.withColumn("share", F.col("n") / total)


def scores(counts):
    """Adds every rate that follows from tn, fp, fn, tp; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    out = counts.withColumn("accuracy", ratio(tp + tn, tn + fp + fn + tp))
    out = out.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    out = out.withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
    out = out.withColumn("specificity", ratio(tn, tn + fp)).withColumn("npv", ratio(tn, tn + fn))
    return out.withColumn("fpr", ratio(fp, fp + tn)).withColumn("fnr", ratio(fn, fn + tp))


def histogram(df, truth="y_true", prob="prob"):
    """(prob, pos, neg) per distinct score; rows without a score count nowhere."""
    return (
        df.filter(F.col(prob).isNotNull())
        .groupBy(F.col(prob).cast("double").alias("prob"))
        .agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    )


def _from_the_top(df, truth, prob):
    """The histogram with totals of each class at and above every score."""
    return running_totals(histogram(df, truth, prob), [F.col("prob").desc()], ["pos", "neg"])


def auc(df, truth="y_true", prob="prob"):
    """(auc): ties count half; NULL when a class is missing."""
    ranked = _from_the_top(df, truth, prob)
    area = F.sum(F.col("neg") * (F.col("pos_upto") - F.col("pos") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(F.try_divide(area, pairs).alias("auc"))


def roc(df, truth="y_true", prob="prob"):
    """(threshold, fpr, tpr), one point per distinct score."""
    ranked = _from_the_top(df, truth, prob)
    pos, neg = ranked.agg(F.sum("pos"), F.sum("neg")).first()
    return ranked.select(
        F.col("prob").alias("threshold"),
        F.try_divide(F.col("neg_upto").cast("double"), F.lit(neg).cast("double")).alias("fpr"),
        F.try_divide(F.col("pos_upto").cast("double"), F.lit(pos).cast("double")).alias("tpr"),
    )


def roc_area(points):
    """Trapezoid area under ``roc`` points, from the corner (0, 0)."""
    pairs = previous(points, ["fpr", "tpr"], ["fpr", "tpr"])
    last_fpr = F.coalesce("fpr_before", F.lit(0.0))
    last_tpr = F.coalesce("tpr_before", F.lit(0.0))
    slabs = pairs.select(
        ((F.col("fpr") - last_fpr) * (F.col("tpr") + last_tpr) / 2.0).alias("slab")
    )
    return slabs.agg(F.sum("slab").alias("area"))


def operating_point(points, threshold):
    """The ROC point whose threshold is nearest; the higher one on a tie."""
    return points.orderBy(
        F.abs(F.col("threshold") - threshold), F.col("threshold").desc()
    ).limit(1)


def report(df, truth="y_true", pred="y_pred", names=("Benign", "Attack")):
    """(class, precision, recall, f1, support): per class, macro, weighted, accuracy."""
    cells = confusion(df, (), truth, pred)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def line(name, hit, claimed, actual):
        return F.struct(
            F.lit(name).alias("class"),
            ratio(hit, claimed).alias("precision"),
            ratio(hit, actual).alias("recall"),
            ratio(2 * hit, claimed + actual).alias("f1"),
            actual.alias("support"),
        )

    wide = cells.select(
        line(names[0], tn, tn + fn, tn + fp).alias("a"),
        line(names[1], tp, tp + fp, tp + fn).alias("b"),
        (tn + fp + fn + tp).alias("n"),
        (tn + tp).alias("hits"),
    )
    fields = ("precision", "recall", "f1")

    def blend(name, one, two):
        return F.struct(
            F.lit(name).alias("class"),
            *[(F.col(f"a.{f}") * one + F.col(f"b.{f}") * two).alias(f) for f in fields],
            F.col("n").alias("support"),
        )

    half = F.lit(0.5)
    share = F.struct(
        F.lit("accuracy").alias("class"),
        *[ratio(F.col("hits"), F.col("n")).alias(f) for f in fields],
        F.col("n").alias("support"),
    )
    weigh_a, weigh_b = (ratio(F.col(f"{x}.support"), F.col("n")) for x in "ab")
    lines = F.array(
        F.col("a"), F.col("b"), share, blend("macro avg", half, half),
        blend("weighted avg", weigh_a, weigh_b),
    )
    return wide.select(F.explode(lines).alias("e")).select("e.*")


def threshold_sweep(df, first, last, truth="y_true", prob="prob"):
    """(threshold, tn, fp, fn, tp, rates) for first..last hundredths, strict ``>``.

    A row is counted once, by how many thresholds it exceeds; the confusion
    counts of all thresholds are running sums over those few counts.
    """
    grid = [i / 100.0 for i in range(first, last + 1)]
    passed = sum([F.when(F.col(prob) > t, 1).otherwise(0) for t in grid], F.lit(0))
    counts = df.groupBy(passed.alias("_i")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg")
    )
    n = len(grid)
    sums = counts.agg(
        *[F.coalesce(F.sum(F.when(F.col("_i") > i, F.col("pos"))), F.lit(0)).alias(f"tp{i}") for i in range(n)],
        *[F.coalesce(F.sum(F.when(F.col("_i") > i, F.col("neg"))), F.lit(0)).alias(f"fp{i}") for i in range(n)],
        F.coalesce(F.sum("pos"), F.lit(0)).alias("p"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("q"),
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(t).alias("threshold"),
                (F.col("q") - F.col(f"fp{i}")).alias("tn"),
                F.col(f"fp{i}").alias("fp"),
                (F.col("p") - F.col(f"tp{i}")).alias("fn"),
                F.col(f"tp{i}").alias("tp"),
            )
            for i, t in enumerate(grid)
        ]
    )
    return scores(sums.select(F.explode(lines).alias("e")).select("e.*"))


def best_threshold(sweep, by=("accuracy", "f1")):
    """The sweep's row that is best by the given metrics; the first one on a tie."""
    order = [F.round(m, 12).desc() for m in by]
    return sweep.orderBy(*order, F.col("threshold")).limit(1)


def fold_summary(df, columns):
    """(metric, mean, std) over folds, with the sample deviation."""
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("metric"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")
            ).alias(c)
            for c in columns
        ]
    )
    return wide.select(F.explode(F.array(*columns)).alias("e")).select("e.*")


def summed_confusion(folds):
    """Fold confusions added up, with the rates of the sum."""
    return scores(folds.agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")]))


def compare(rows, columns):
    """Metric rows of several models with a percent text per metric."""
    return rows.withColumns(
        {f"{c}_pct": F.format_string("%.2f%%", F.col(c) * 100.0) for c in columns}
    )


def improvement(rows, column, baseline):
    """Relative gain in percent over a baseline value."""
    return rows.withColumn("improvement", (F.col(column) - baseline) / baseline * 100.0)


def latency_summary(timings):
    """(batch_size, latency_ms, std_latency, throughput) from total times per run."""
    each = F.col("total_ms") / F.col("batch_size")
    return (
        timings.groupBy("batch_size")
        .agg(F.avg(each).alias("latency_ms"), F.stddev_pop(each).alias("std_latency"))
        .withColumn("throughput", F.try_divide(F.lit(1000.0), F.col("latency_ms")))
    )


def capability(summary):
    """Speed and network tiers of a latency summary."""
    # Tier names and their limits in ms per row and rows per second.
    speed = (
        F.when(F.col("latency_ms") < 1, "Real-time")
        .when(F.col("latency_ms") < 10, "Near real-time")
        .when(F.col("latency_ms") < 100, "Batch mode")
        .otherwise("Not suitable")
    )
    network = (
        F.when(F.col("throughput") >= 100_000, "10 Gbps+")
        .when(F.col("throughput") >= 10_000, "1 Gbps")
        .otherwise("Sub-Gbps")
    )
    return summary.withColumn("capability", speed).withColumn("network_capacity", network)


def best_epoch(log, by="val_auc"):
    """(best_epoch, value): first maximum, counted from 1; epochs start at 0."""
    return log.agg(
        (F.min_by("epoch", F.struct(-F.col(by), F.col("epoch"))) + 1).alias("best_epoch"),
        F.max(by).alias(by),
    )


def fnr_tier(rates):
    # Limits of the miss rate, in percent.
    percent = F.col("fnr") * 100
    tier = F.when(percent < 5, "excellent").when(percent < 10, "good")
    return rates.withColumn("tier", tier.otherwise("needs improvement"))
