"""Queries: AUC, accuracy/loss, bootstrap."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators import bootstrap as B
from cohortlens.operators import metrics as M
from cohortlens.plans.catalog import register
from cohortlens.sources import testdata as td


@register("auc_global")
def auc_global(spark, sf_dir):
    """A8 over all predictions, heavily tied scores."""
    return M.auc(td.predictions(spark, sf_dir), "label", "prob")


@register("auc_by_group")
def auc_by_group(spark, sf_dir):
    """A8 per l_linestatus."""
    return M.auc(td.predictions(spark, sf_dir), "label", "prob", by="l_linestatus")


@register("auc_many_scores")
def auc_many_scores(spark, sf_dir):
    """A8 with (almost) all-distinct scores: bucketed prefix sums."""
    return M.auc(td.predictions(spark, sf_dir), "label", "score", by="l_linestatus")


@register("accuracy_bce")
def accuracy_bce(spark, sf_dir):
    """A9 accuracy at 0.5 and A11 BCE from the logit of the score."""
    p = td.predictions(spark, sf_dir).withColumn("z", M.logit("score"))
    return p.groupBy("l_linestatus").agg(
        M.accuracy("label", "score").alias("accuracy"),
        M.bce_with_logits("z", "label").alias("bce"),
        F.count(F.lit(1)).alias("n"))


@register("bootstrap_auc")
def bootstrap_auc(spark, sf_dir):
    """R4 + A10: 100-replicate Poisson bootstrap of AUC per l_linestatus (flagship, L5)."""
    p = td.predictions(spark, sf_dir)
    return B.bootstrap(p, B.auc_metric("label", "prob"), by="l_linestatus", n=100)


@register("bootstrap_auc_scores")
def bootstrap_auc_scores(spark, sf_dir):
    """R4 on (almost) all-distinct scores: each row moves once, replicates are drawn in its bucket."""
    return B.bootstrap(td.predictions(spark, sf_dir), B.auc_metric("label", "score"), by="l_linestatus", n=100)


@register("bootstrap_small_groups")
def bootstrap_small_groups(spark, sf_dir):
    """R4 on groups of 1 to 4 rows (half orders): a replicate without rows has no accuracy and no mean logarithm of the score."""
    p = td.predictions(spark, sf_dir)
    order, line = F.split("rowkey", "[|]")[0].cast("bigint"), F.split("rowkey", "[|]")[1].cast("int")
    p = p.withColumn("grp", order * 2 + (line > 4).cast("int")).withColumn("log_score", F.log("score"))
    return B.bootstrap(p, [B.accuracy_metric("label", "score"), B.mean_metric("log_score")], by="grp", n=20)


@register("bootstrap_multi_metric")
def bootstrap_multi_metric(spark, sf_dir):
    """Tuple metric (AUC, accuracy) bootstrapped together, no groups."""
    p = td.predictions(spark, sf_dir)
    return B.bootstrap(p, [B.auc_metric("label", "prob"), B.accuracy_metric("label", "score")], n=100)


@register("bootstrap_empty_cells")
def bootstrap_empty_cells(spark, sf_dir):
    """All group-value combinations, empty ones with NULL metrics."""
    p = td.predictions(spark, sf_dir).withColumn(
        "band", F.when((F.col("l_linestatus") == "O") & (F.col("prob") >= 0.05), "hi")
                 .when(F.col("prob") < 0.05, "lo").otherwise("mid"))
    return B.bootstrap(p, B.auc_metric("label", "prob"), by=["l_linestatus", "band"], n=100, include_empty=True)


@register("bootstrap_exact")
def bootstrap_exact(spark, sf_dir):
    """R4 exact mode: fixed-size resamples with replacement (multinomial draws down a block tree)."""
    p = td.predictions(spark, sf_dir)
    return B.bootstrap(p, B.auc_metric("label", "prob"), by="l_linestatus", n=100, mode="multinomial")


@register("bootstrap_exact_sizes")
def bootstrap_exact_sizes(spark, sf_dir):
    """R4 exact mode, what it promises: every replicate draws exactly the group's number of rows, with about Poisson(1) copies."""
    p = td.predictions(spark, sf_dir)
    w = B.multinomial_weights(p, "rowkey", ["l_linestatus"], ["l_returnflag"], n=100, block_rows=500)
    flags = p.groupBy("l_linestatus", "l_returnflag").agg(F.count(F.lit(1)).alias("rows"))
    drawn = w.groupBy("l_linestatus", "replicate", "l_returnflag").agg(F.sum("weight").alias("n")).join(flags, ["l_linestatus", "l_returnflag"])
    # a binomial share of n_g draws: within six standard deviations of its mean
    total = F.sum("rows").over(Window.partitionBy("l_linestatus", "replicate"))
    near = F.abs(F.col("n") - F.col("rows")) <= 6 * F.sqrt(F.col("rows") * (1 - F.col("rows") / F.col("total"))) + 1
    return drawn.withColumn("total", total).groupBy("l_linestatus", "replicate").agg(
        F.sum("n").alias("drawn"), F.min(near.cast("int")).alias("near"))


def _confusion(state, columns, weight):
    hit, label = columns["score"] > 0.5, columns["label"] == 1
    cells = [(label & hit), (label & ~hit), (~label & ~hit), (~label & hit)]
    return [s + int(weight[c].sum()) for s, c in zip(state, cells)]


def _rates(state):
    tp, fn, tn, fp = state
    return (tp / (tp + fn) if tp + fn else None, tn / (tn + fp) if tn + fp else None)


#: Sensitivity and specificity at 0.5, as a user would write them in Python.
RATES = B.PythonAggregate("rates", ("label", "score"), lambda: [0, 0, 0, 0], _confusion, lambda a, b: [x + y for x, y in zip(a, b)], _rates, 2)
#: Weighted mean of the scores of positive rows.
POSITIVE_MEAN = B.PythonAggregate(
    "positive_mean", ("label", "score"), lambda: (0, 0.0),
    lambda s, c, w: (s[0] + int(w[c["label"] == 1].sum()), s[1] + float((w * c["score"])[c["label"] == 1].sum())),
    lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[1] / s[0] if s[0] else None)


@register("bootstrap_python_scalar")
def bootstrap_python_scalar(spark, sf_dir):
    """A scalar Python aggregate bootstrapped per l_linestatus."""
    return B.bootstrap(td.predictions(spark, sf_dir), B.python_metric(POSITIVE_MEAN), by="l_linestatus", n=50)


@register("bootstrap_python_tuple")
def bootstrap_python_tuple(spark, sf_dir):
    """A tuple-valued Python aggregate (sensitivity, specificity) beside a built-in metric."""
    return B.bootstrap(td.predictions(spark, sf_dir), [B.python_metric(RATES), B.accuracy_metric("label", "score")], by="l_linestatus", n=50)


@register("logit_metrics")
def logit_metrics(spark, sf_dir):
    """Two-logit outputs [0, logit(score)]: softmax and sigmoid probabilities,
    arg-max accuracy, BCE against the one-hot label (N x 2) and from the single logit (N x 1)."""
    p = td.predictions(spark, sf_dir).withColumn("z", M.logit("score"))
    p = p.withColumn("logits", F.array(F.lit(0.0), F.col("z")))
    return p.groupBy("l_linestatus").agg(
        F.avg(M.softmax2_prob1(F.col("logits")[0], F.col("logits")[1])).alias("mean_softmax"),
        F.avg(M.sigmoid("z")).alias("mean_sigmoid"),
        F.avg((M.argmax_index("logits") == F.col("label")).cast("double")).alias("argmax_acc"),
        M.bce_with_logits_onehot("logits", "label").alias("bce_onehot"),
        M.bce_with_logits("z", "label").alias("bce_single"))
