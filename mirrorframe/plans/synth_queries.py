"""Registered queries over the synthesizers and subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions import patterns
from mirrorframe.functions import random as rnd
from mirrorframe.functions import scalar as S
from mirrorframe.functions.permutation import permuted
from mirrorframe.operators import subset
from mirrorframe.plans import views as V
from mirrorframe.sources.metadata import ColumnSpec, Metadata, Relationship, TableSpec, infer_table
from mirrorframe.synth import encoder, lookup, simple
from mirrorframe.synth.copula import BootstrapSynthesizer, GaussianCopulaSynthesizer, SegmentSynthesizer
from mirrorframe.synth.tables import HierarchicalSynthesizer, IndependentSynthesizer

SAMPLED = ["l_linenumber", *V.NUMERIC, *V.CATEGORICAL, *V.DATETIME]


def star(spark, sf_dir) -> tuple[dict[str, DataFrame], Metadata]:
    """The seven linked tables and their metadata."""
    data = {t: V.table(spark, sf_dir, t) for t in V.STAR_TABLES}
    primary = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
               "part": "p_partkey", "orders": "o_orderkey", "lineitem": None}
    foreign = {t: tuple(r[3] for r in V.RELATIONSHIPS if r[2] == t) for t in V.STAR_TABLES}
    tables = {t: infer_table(df, primary[t], foreign[t]) for t, df in data.items()}
    return data, Metadata(tables, [Relationship(*r) for r in V.RELATIONSHIPS])


def micros(df: DataFrame) -> DataFrame:
    """Datetimes as epoch micros, to compare engines without time zones."""
    return df.withColumns({c: S.to_micros(F.col(c)) for c in simple.times(df.schema)})


def _lines(spark, sf_dir, *more):
    return V.table(spark, sf_dir, "lineitem").select(*more, *SAMPLED)


def identity_sample(spark, sf_dir):
    data = V.table(spark, sf_dir, "supplier")
    model = simple.IdentitySynthesizer()
    return model.sample(model.fit(data, None), data.count())


def uniform_sample(spark, sf_dir):
    data = _lines(spark, sf_dir)
    maker = simple.UniformSynthesizer(7)
    out = micros(maker.sample(maker.fit(data), data.count(), row_id="id"))
    return out.withColumns({c: F.round(c, 6) for c in V.NUMERIC})


def uniform_multi_table(spark, sf_dir):
    """Customers and orders at half size, drawn per table; one table of (table, row values) to compare."""
    data = {t: V.table(spark, sf_dir, t) for t in ("customer", "orders")}
    maker = simple.MultiTableUniformSynthesizer(3)
    drawn = maker.sample(maker.fit(data), 0.5)
    customers = drawn["customer"].select(
        F.lit("customer").alias("table_name"), F.col("c_custkey").alias("key"), F.col("c_name").alias("text"),
        F.round("c_acctbal", 6).alias("amount"))
    orders = drawn["orders"].select(
        F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("text"),
        F.round("o_totalprice", 6).alias("amount"))
    return customers.unionByName(orders)


def column_resample(spark, sf_dir):
    """Text columns of parts resampled by frequency, as the column synthesizer does."""
    data = V.table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type")
    ranges, sizes = lookup.frequency_ranges(lookup.value_counts(data, data.columns), ["column"])
    drawn = lookup.row_ids(spark, data.count())
    for (c,), (total, distinct) in sizes.items():
        drawn = drawn.withColumn(c, rnd.index(5, c, F.col("id"), F.lit(total)))
        drawn = lookup.range_lookup(drawn, c, ranges.where(F.col("column") == c), total, distinct, c)
    return drawn.select("id", "p_name", "p_brand", "p_type")


def bootstrap_rows(spark, sf_dir):
    data = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return simple.bootstrap_rows(data, ["o_orderkey"], data.count(), 11)


def label_sample(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    return simple.label_sample(docs, "lang", docs.count(), 13)


def _mixed(spark, sf_dir):
    """Lineitem with missing values and an id column."""
    data = V.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.nullif("l_linenumber", F.lit(7)).alias("line"),
        F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("discount"),
        F.nullif("l_returnflag", F.lit("R")).alias("flag"), F.col("l_linestatus").alias("status"),
        F.date_format("l_shipdate", "dd MMM yyyy").alias("shipped"),
    )
    table = TableSpec({
        "line": ColumnSpec("numerical"), "discount": ColumnSpec("numerical"), "flag": ColumnSpec("categorical"),
        "status": ColumnSpec("categorical"), "shipped": ColumnSpec("datetime", datetime_format="%d %b %Y"),
        "l_partkey": ColumnSpec("id"),
    })
    return data, table


def mixed_encode(spark, sf_dir):
    data, table = _mixed(spark, sf_dir)
    model = encoder.fit(data, table, normal_scores=False)
    out = encoder.encode(data, model, keep=("l_orderkey", "l_partkey", "l_suppkey"))
    return out.withColumns({c: F.round(c, 6) for c in ("line", "discount")}).withColumn("shipped", F.round("shipped", 0))


def mixed_decode(spark, sf_dir):
    """Codes and numbers disturbed, then turned back into values."""
    data, table = _mixed(spark, sf_dir)
    model = encoder.fit(data, table, normal_scores=False)
    coded = encoder.encode(data, model, keep=("l_orderkey", "l_suppkey"))
    moved = coded.withColumns({
        "line": F.col("line") + 0.4, "flag": F.col("flag") + 0.3, "shipped": F.col("shipped") + 0.3,
    })
    # Rows that are equal in all of these are equal: any order of them has the same result.
    out = encoder.decode(moved, model, order=["l_orderkey", "l_suppkey", "line", "discount", "flag", "status", "shipped"])
    return out.withColumn("discount", F.round("discount", 6)).drop("id")


def mixed_normal_scores(spark, sf_dir):
    """Round trip through normal scores."""
    data, table = _mixed(spark, sf_dir)
    model = encoder.fit(data, table)
    scores = encoder.encode(data, model, keep=("l_orderkey",))
    return encoder.decode(scores.withColumn("id", F.col("l_orderkey")), model)


def gaussian_copula_sample(spark, sf_dir):
    data = _lines(spark, sf_dir)
    maker = GaussianCopulaSynthesizer(1)
    return maker.sample(maker.fit(data), data.count())


def bootstrap_sample(spark, sf_dir):
    data = _lines(spark, sf_dir)
    maker = BootstrapSynthesizer(1)
    return maker.sample(maker.fit(data), data.count())


def column_gmm_sample(spark, sf_dir):
    data = V.table(spark, sf_dir, "customer").select("c_acctbal", "c_mktsegment", "c_nationkey")
    maker = simple.ColumnSynthesizer(1)
    return maker.sample(maker.fit(data), data.count())


def segment_sample(spark, sf_dir):
    data = _lines(spark, sf_dir)
    maker = SegmentSynthesizer(1)
    return maker.sample(maker.fit(data), data.count())


def _digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, digest): all rows of all tables, each as the digest of its columns."""
    out = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("table_name"), F.md5(F.to_json(F.struct(*df.columns))).alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


def independent_sample(spark, sf_dir):
    data, metadata = star(spark, sf_dir)
    maker = IndependentSynthesizer(1)
    return _digests(maker.sample(maker.fit(data, metadata)))


def hierarchical_sample(spark, sf_dir):
    data, metadata = star(spark, sf_dir)
    maker = HierarchicalSynthesizer(1)
    return _digests(maker.sample(maker.fit(data, metadata)))


CUSTOMERS = TableSpec({
    "c_custkey": ColumnSpec("id"), "c_name": ColumnSpec("name", pii=True), "c_nationkey": ColumnSpec("categorical"),
    "c_acctbal": ColumnSpec("numerical"), "c_mktsegment": ColumnSpec("categorical"),
}, primary_key="c_custkey")


def metadata_copula_sample(spark, sf_dir):
    """Customers by their metadata: new keys and names, nations as categories, the rest by the copula."""
    data = V.table(spark, sf_dir, "customer").select(*CUSTOMERS.columns)
    maker = GaussianCopulaSynthesizer(1)
    return maker.sample(maker.fit(data, CUSTOMERS), data.count())


def surrogate_keys(spark, sf_dir):
    """Customers under other keys and made-up addresses: a permutation of the keys, and text by pattern."""
    customers = V.table(spark, sf_dir, "customer")
    n = customers.count()
    mail = patterns.Pattern(*patterns.PERSONAL["email"])
    return customers.select(
        "c_custkey", permuted(21, "key", F.col("c_custkey"), n).alias("surrogate"),
        patterns.made(mail, 22, "mail", F.col("c_custkey"), n).alias("email"), "c_mktsegment")


# --- subsets ----------------------------------------------------------------------------------------

def row_cap(spark, sf_dir):
    return micros(subset.row_cap(V.table(spark, sf_dir, "orders"), ["o_orderkey"], 1000, seed=2))


def column_trim(spark, sf_dir):
    lines = V.table(spark, sf_dir, "lineitem")
    return micros(subset.trim_columns(lines, ["l_suppkey"], optional=4))


def sequence_trim(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    table = infer_table(events)
    table.sequence_key, table.sequence_index = "user_id", "ts"
    return micros(subset.table_subset(events, table, ["event_id"], rows=500, optional=2, seed=4))


def referential_subset(spark, sf_dir):
    """Keys of the rows kept in every table of the star."""
    data, metadata = star(spark, sf_dir)
    kept = subset.referential_subset(
        data, metadata, {"lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]}, rows=1000, seed=6
    )
    key = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
           "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    out = None
    for name, df in kept.items():
        one = df.groupBy(F.lit(name).alias("table_name"), F.col(key[name]).cast("bigint").alias("key")).agg(
            F.count(F.lit(1)).alias("num_rows"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    f.__name__: f
    for f in [
        identity_sample, uniform_sample, uniform_multi_table, column_resample, bootstrap_rows, label_sample,
        mixed_encode, mixed_decode, mixed_normal_scores, gaussian_copula_sample, bootstrap_sample,
        column_gmm_sample, segment_sample, independent_sample, hierarchical_sample, metadata_copula_sample, surrogate_keys,
        row_cap, column_trim, sequence_trim, referential_subset,
    ]
}
