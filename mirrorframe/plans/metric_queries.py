"""Registered queries over the metrics, the reports and the dataset profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirrorframe.metrics import efficacy, likelihood, pairs, privacy, report, sequences, shapes, validity
from mirrorframe.operators import catalog as C
from mirrorframe.plans import views as V
from mirrorframe.plans.result_queries import rounded
from mirrorframe.plans.synth_queries import SAMPLED, star
from mirrorframe.session import materialize
from mirrorframe.sources.metadata import infer_table
from mirrorframe.synth import simple

NUMBERS = [*V.NUMERIC, *V.DATETIME]


def ks_complement(spark, sf_dir):
    return rounded(shapes.ks_complement(*V.real_and_synthetic(spark, sf_dir), NUMBERS), "score")


def tv_complement(spark, sf_dir):
    return rounded(shapes.tv_complement(*V.real_and_synthetic(spark, sf_dir), V.CATEGORICAL), "score")


def chi_square_stat(spark, sf_dir):
    out = shapes.chi_square(*V.real_and_synthetic(spark, sf_dir), [*V.CATEGORICAL, "l_linenumber"])
    return rounded(out, "statistic").drop("score")


def correlation_similarity(spark, sf_dir):
    return rounded(pairs.correlation_similarity(*V.real_and_synthetic(spark, sf_dir), V.NUMERIC), "score")


def contingency_similarity(spark, sf_dir):
    out = pairs.contingency_similarity(*V.real_and_synthetic(spark, sf_dir), V.CATEGORICAL, V.NUMERIC)
    return rounded(out, "score")


def _single(spark, sf_dir):
    real, synthetic = V.real_and_synthetic(spark, sf_dir)
    columns = [*V.NUMERIC, *V.CATEGORICAL, *V.DATETIME]
    real, synthetic = real.select(*columns), synthetic.select(*columns)
    return real, synthetic, infer_table(real)


def quality_report(spark, sf_dir):
    return rounded(report.quality_report(*_single(spark, sf_dir)), "score")


def diagnostic_report(spark, sf_dir):
    real, synthetic, table = _single(spark, sf_dir)
    return rounded(report.diagnostic_report(real, synthetic, table), "score")


def uniform_quality(spark, sf_dir):
    """Quality of a uniform synthesizer's sample of the whole table."""
    data = V.table(spark, sf_dir, "lineitem").select(*SAMPLED)
    maker = simple.UniformSynthesizer(7)
    # The report reads the sample several times; it is drawn once.
    drawn = materialize(maker.sample(maker.fit(data), data.count()))
    return rounded(report.quality_report(data, drawn, infer_table(data)), "score")


def boundary_adherence(spark, sf_dir):
    return rounded(validity.boundary_adherence(*V.real_and_synthetic(spark, sf_dir), NUMBERS), "score")


def category_adherence(spark, sf_dir):
    """Parts of a twelfth of the sizes and keys against all others: every part is on one side."""
    parts = V.table(spark, sf_dir, "part")
    few = "(p_size % 4 = 0 and p_partkey % 3 = 0)"
    out = validity.category_adherence(parts.where(few), parts.where(f"not {few}"), ["p_name", "p_brand", "p_type"])
    return rounded(out, "score")


def key_uniqueness(spark, sf_dir):
    return rounded(validity.key_uniqueness(V.table(spark, sf_dir, "lineitem"), "l_orderkey"), "score")


def referential_integrity(spark, sf_dir):
    customers = V.table(spark, sf_dir, "customer").where("c_nationkey % 3 <> 0")
    return rounded(validity.referential_integrity(V.table(spark, sf_dir, "orders"), "o_custkey", customers, "c_custkey"), "score")


def cardinality_shape(spark, sf_dir):
    orders, lines = V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "lineitem")
    real, synthetic = V.real_and_synthetic(spark, sf_dir)
    out = validity.cardinality_shape(
        (orders, real), (orders.where("o_custkey % 3 = 0"), lines), "o_orderkey", "l_orderkey")
    return rounded(out, "score")


def structure(spark, sf_dir):
    """The catalog of all lines against that of the lines of real orders."""
    out = validity.structure_overlap(V.catalog(spark, sf_dir), V.catalog(spark, sf_dir, "l_orderkey % 2 = 0"))
    return rounded(out, "score")


def new_row_synthesis(spark, sf_dir):
    out = validity.new_row_synthesis(*V.real_and_synthetic(spark, sf_dir), V.CATEGORICAL, ["l_quantity", "l_discount", "l_tax"])
    return rounded(out, "score")


def multi_table_diagnostic(spark, sf_dir):
    """The star against itself with the customers of some nations gone."""
    data, metadata = star(spark, sf_dir)
    synthetic = {**data, "customer": data["customer"].where("c_nationkey % 3 <> 0")}
    return rounded(report.multi_table_diagnostic_report(data, synthetic, metadata), "score")


def multi_table_quality(spark, sf_dir):
    data, metadata = star(spark, sf_dir)
    synthetic = {**data, "orders": data["orders"].where("o_orderkey % 2 = 0")}
    return rounded(report.multi_table_quality_report(data, synthetic, metadata), "score")


def dcr_baseline(spark, sf_dir):
    real, synthetic = V.real_and_synthetic(spark, sf_dir)
    return privacy.baseline_protection(real, synthetic, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], V.CATEGORICAL)


def mutual_information(spark, sf_dir):
    lines = V.table(spark, sf_dir, "lineitem")
    return rounded(pairs.mutual_information(lines, V.CATEGORICAL, V.NUMERIC), "mutual_information")


def bn_log_likelihood(spark, sf_dir):
    return likelihood.bn_log_likelihood(*V.real_and_synthetic(spark, sf_dir), V.CATEGORICAL, V.NUMERIC)


def gm_log_likelihood(spark, sf_dir):
    """Ten fits of 10 and ten of 30 components: a row per (components, seed), with the mean of the ten."""
    return likelihood.gm_scores(*V.real_and_synthetic(spark, sf_dir), V.NUMERIC)


def _documents(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").join(V.table(spark, sf_dir, "labels"), "doc_id")
    return docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")


def _scores(frame, found):
    return frame.agg(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.lit(v).alias("score")) for k, v in found
    ]).alias("all")).select(F.explode("all").alias("s")).select("s.*")


def tree_efficacy(spark, sf_dir):
    real, synthetic = _documents(spark, sf_dir)
    found = efficacy.classifier_efficacy(real, synthetic, ["n_chars", "toxic"], ["lang", "source"], "quality",
                                         ["decision_tree", "boosted_trees"])
    return _scores(synthetic, found)


def logistic_efficacy(spark, sf_dir):
    real, synthetic = _documents(spark, sf_dir)
    found = efficacy.classifier_efficacy(real, synthetic, ["n_chars", "toxic"], ["lang", "source"], "quality",
                                         ["logistic_regression", "mlp"])
    return _scores(synthetic, found)


def multiclass_efficacy(spark, sf_dir):
    real, synthetic = V.real_and_synthetic(spark, sf_dir)
    found = efficacy.classifier_efficacy(real, synthetic, NUMBERS, ["l_linestatus"], "l_returnflag", ["decision_tree", "mlp"])
    return _scores(synthetic, found)


def linear_efficacy(spark, sf_dir):
    real, synthetic = V.real_and_synthetic(spark, sf_dir)
    score = efficacy.regression_efficacy(real, synthetic, ["l_quantity", "l_discount", "l_tax"], V.CATEGORICAL, "l_extendedprice")
    return _scores(synthetic, [("linear_regression", score)])


def sequence_features(spark, sf_dir):
    out = sequences.interval_features(V.table(spark, sf_dir, "events"), "user_id", "ts", "value")
    return rounded(out, "mean", "sd", "slope")


def random_interval_features(spark, sf_dir):
    """The statistics that the forests over sequences see, of eight intervals; values are whole hundredths, whose sums are exact."""
    events = V.table(spark, sf_dir, "events").withColumn("value", F.round(F.col("value") * 100))
    parts = sequences.micro_buckets(events, "user_id", "ts", "value")
    out = rounded(sequences.random_interval_features(parts, sequences.random_intervals(8, 17)), "mean", "sd")
    # Two rows close in time have slopes of millions; doubles hold these to fewer places.
    return out.withColumn("slope", F.round("slope", 3))


def _events(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    return events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")


def sequence_detection(spark, sf_dir):
    real, synthetic = _events(spark, sf_dir)
    return _scores(synthetic, [("detection", sequences.detection(real, synthetic, "user_id", "ts", "value"))])


def sequence_efficacy(spark, sf_dir):
    """Labels: whether a user's errors outnumber its other events' average share."""
    real, synthetic = _events(spark, sf_dir)
    labels = tuple(
        df.groupBy("user_id").agg((F.avg((F.col("event_type") == "error").cast("int")) > 0.2).alias("label"))
        for df in (real, synthetic))
    score = sequences.classifier_efficacy(real, synthetic, labels, "user_id", "ts", "value")
    return _scores(synthetic, [("classifier", score)])


# --- dataset profile --------------------------------------------------------------------------------

def metadata_counts(spark, sf_dir):
    return C.metadata_counts(V.catalog(spark, sf_dir))


def relationships(spark, sf_dir):
    return C.relationships(V.edges(spark, sf_dir))


def schema_depth(spark, sf_dir):
    return C.schema_depth(V.catalog(spark, sf_dir), V.edges(spark, sf_dir))


def row_counts(spark, sf_dir):
    return C.row_counts(V.table_rows(spark, sf_dir))


def dataset_rows(spark, sf_dir):
    """Row totals of the star dataset."""
    data, _ = star(spark, sf_dir)
    return C.total_rows(C.count_tables(data, "star"))


def dataset_summary(spark, sf_dir):
    return C.dataset_summary(V.catalog(spark, sf_dir), V.edges(spark, sf_dir), C.row_counts(V.table_rows(spark, sf_dir)))


def dataset_size(spark, sf_dir):
    return rounded(C.dataset_size(V.table(spark, sf_dir, "documents")), "size_MB")


def dataset_summary_filter(spark, sf_dir):
    counts = C.row_counts(V.table_rows(spark, sf_dir))
    return C.total_rows(counts.where(F.col("dataset").isin("d1", "d2", "d9")))


QUERIES = {
    f.__name__: f
    for f in [
        ks_complement, tv_complement, chi_square_stat, correlation_similarity, contingency_similarity, quality_report,
        diagnostic_report, uniform_quality, boundary_adherence, category_adherence, key_uniqueness,
        referential_integrity, structure, cardinality_shape, new_row_synthesis, multi_table_diagnostic, multi_table_quality,
        dcr_baseline, mutual_information, bn_log_likelihood, gm_log_likelihood, tree_efficacy, logistic_efficacy,
        multiclass_efficacy, linear_efficacy, sequence_features, random_interval_features, sequence_detection, sequence_efficacy,
        metadata_counts, relationships, schema_depth, row_counts, dataset_rows, dataset_summary, dataset_size,
        dataset_summary_filter,
    ]
}
