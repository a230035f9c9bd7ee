import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorframe.functions import patterns, permutation
from mirrorframe.functions.moments import moments
from mirrorframe.metrics import report
from mirrorframe.sources.metadata import ColumnSpec, Metadata, Relationship, TableSpec
from mirrorframe.synth.copula import GaussianCopulaSynthesizer, SegmentSynthesizer
from mirrorframe.synth.roles import roles_of
from mirrorframe.synth.simple import ColumnSynthesizer, UniformSynthesizer
from mirrorframe.synth.tables import HierarchicalSynthesizer, IndependentSynthesizer

# Primary key, ids and personal data of a hotel's guests.
GUESTS = TableSpec({
    "guest_email": ColumnSpec("email", pii=True), "has_rewards": ColumnSpec("boolean"), "room_type": ColumnSpec("categorical"),
    "amenities_fee": ColumnSpec("numerical"), "checkin_date": ColumnSpec("datetime", datetime_format="%d %b %Y"), "floor": ColumnSpec("categorical"),
    "billing_address": ColumnSpec("address", pii=True), "credit_card_number": ColumnSpec("credit_card_number", pii=True),
    "loyalty": ColumnSpec("id"), "odd": ColumnSpec("mystery"), "badge": ColumnSpec("badge_code", pii=True), "room_id": ColumnSpec("id"),
}, primary_key="guest_email", alternate_keys=["room_id"])


@pytest.fixture(scope="module")
def guests(spark):
    i = F.col("id")
    return spark.range(2000).select(
        F.concat(F.lit("user."), i.cast("string"), F.lit("@shaw.net")).alias("guest_email"), (i % 3 == 0).alias("has_rewards"),
        F.element_at(F.array(*[F.lit(x) for x in ("BASIC", "SUITE", "DELUXE")]), (i % 3 + 1).cast("int")).alias("room_type"),
        F.when(i % 10 > 0, i / 7).alias("amenities_fee"), F.date_format(F.timestamp_seconds(i * 86_400), "dd MMM yyyy").alias("checkin_date"),
        (i % 4).alias("floor"), F.when(i % 5 > 0, F.concat(i.cast("string"), F.lit(" Plot Road"))).alias("billing_address"),
        (F.lit(4_000_000_000_000_000) + i).alias("credit_card_number"), F.concat(F.lit("L-"), (i % 50).cast("string")).alias("loyalty"),
        F.concat(F.lit("o"), (i % 2).cast("string")).alias("odd"), i.cast("string").alias("badge"), (i + 7).cast("int").alias("room_id"),
    )


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 10_007])
def test_permutations_take_each_place_once(spark, n):
    found = [r.p for r in spark.range(n).select(permutation.permuted(3, "k", F.col("id"), n).alias("p")).collect()]
    assert sorted(found) == list(range(n))
    if n > 1:
        for i in range(0, n, 1 + n // 50):
            at = permutation.once(3, "k", i, n)
            while at >= n:
                at = permutation.once(3, "k", at, n)
            assert at == found[i]
    if n > 50:
        other = [r.p for r in spark.range(n).select(permutation.permuted(4, "k", F.col("id"), n).alias("p")).collect()]
        assert sum(a == b for a, b in zip(found, other, strict=True)) < n / 5 and sum(i == p for i, p in enumerate(found)) < n / 5


def test_numbers_that_leave_the_range_are_sent_through_again():
    n = 97
    a, b = permutation.moduli(n)
    assert a * b > n and permutation.walks(3, "k", n) >= 1
    assert sorted(permutation.once(3, "k", i, n) for i in range(a * b)) == list(range(a * b))


def test_patterns(spark):
    one = patterns.Pattern("A-", "^?#.#")
    assert one.capacity == 26 * 26 * 100 and one.holding(10**6).capacity == 26 * 26 * 10_000
    assert one.holding(10**6).body == "##^?#.#"
    found = [r.v for r in spark.range(5000).select(patterns.made(one, 1, "s", F.col("id"), 5000).alias("v")).collect()]
    assert len(set(found)) == 5000 and all(len(v) == 7 and v.startswith("A-") and v[2].isupper() and v[3].islower() and v[5] == "." for v in found)
    few = patterns.Pattern("x", "#")
    assert len({r.v for r in spark.range(500).select(patterns.made(few, 1, "s", F.col("id"), 500).alias("v")).collect()}) == 500


@pytest.mark.parametrize("maker", [
    GaussianCopulaSynthesizer(1), SegmentSynthesizer(1, segments=2), ColumnSynthesizer(1), UniformSynthesizer(1),
], ids=lambda m: m.name)
def test_metadata_decides(spark, guests, maker):
    made = maker.sample(maker.fit(guests, GUESTS), 3000).cache()
    assert made.schema.simpleString() == guests.schema.simpleString() and made.count() == 3000
    for key in ("guest_email", "room_id"):
        assert made.select(key).distinct().count() == 3000 and made.where(F.col(key).isNull()).count() == 0
    for private in ("guest_email", "billing_address", "credit_card_number", "badge"):
        assert made.join(guests.select(private), private, "left_semi").count() == 0
    dates = made.agg(F.count(F.try_to_timestamp("checkin_date", F.lit("dd MMM yyyy"))), F.min(F.length("checkin_date")), F.max(F.length("checkin_date"))).first()
    assert tuple(dates) == (3000, 11, 11)
    shares = made.agg(F.avg(F.col("billing_address").isNull().cast("int")), F.count_distinct("loyalty"), F.count_distinct("floor"), F.count_distinct("odd")).first()
    assert abs(shares[0] - 0.2) < 0.04 and abs(shares[1] - 50) < 8 and shares[2] == 4 and shares[3] == 2
    assert report.overall(report.diagnostic_report(guests, made, GUESTS)) == 1.0
    made.unpersist()


def test_samples_do_not_depend_on_partitions(guests):
    maker = GaussianCopulaSynthesizer(5)
    first, again = (maker.sample(maker.fit(guests.repartition(n), GUESTS), 200).select("guest_email", "credit_card_number", "loyalty", "room_id") for n in (1, 6))
    assert first.exceptAll(again).count() == 0


def test_beginnings_that_real_values_have_are_passed_over(spark, guests):
    roles = roles_of(guests, GUESTS, 1)
    assert roles.made["guest_email"].pattern.lead == "user.1user."  # real addresses begin with user.
    assert roles.made["billing_address"].pattern.lead == "Plot " and roles.made["credit_card_number"].low == 4_000_000_000_002_000
    taken = spark.createDataFrame([(lead,) for lead in ("user.", *[f"user.{k}user." for k in range(1, 8)])], "m string")
    with pytest.raises(ValueError, match="begin with all of"):
        roles_of(taken, TableSpec({"m": ColumnSpec("email", pii=True)}), 1)


def test_tables_of_keys_only_and_empty_ones(spark):
    keys = spark.range(40).select(F.col("id").alias("k"), F.lit(None).cast("string").alias("mail"))
    spec = TableSpec({"k": ColumnSpec("id"), "mail": ColumnSpec("email", pii=True)}, primary_key="k")
    made = GaussianCopulaSynthesizer().sample(GaussianCopulaSynthesizer().fit(keys, spec), 60)
    assert made.agg(F.count_distinct("k"), F.min("k"), F.max("k"), F.count("mail")).first()[:] == (60, 0, 59, 0)
    empty = UniformSynthesizer().sample(UniformSynthesizer().fit(keys.limit(0), spec), 5)
    assert empty.count() == 5 and empty.select("k").distinct().count() == 5


@pytest.fixture(scope="module")
def family(spark):
    """Parents with a group and a size; children whose number and values follow them; grandchildren that follow the children."""
    parents = spark.range(600).select(
        F.col("id").alias("p"), (F.col("id") % 3).cast("string").alias("kind"), F.pmod(F.hash("id"), F.lit(100)).cast("double").alias("size"),
        F.concat(F.lit("p"), F.col("id").cast("string"), F.lit("@x.org")).alias("mail"))
    children = parents.select("p", "kind", "size", F.explode(F.sequence(F.lit(1), F.floor(F.col("size") / 20).cast("int") + 1)).alias("k")).select(
        (F.col("p") * 100 + F.col("k")).alias("c"), "p", (F.col("size") * 2 + F.hash("p", "k") % 20).alias("amount"),
        F.when(F.hash("k", "p") % 10 < 8, F.concat(F.lit("t"), F.col("kind"))).otherwise("other").alias("tag"))
    grand = children.select("c", "amount", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).select("c", (F.col("amount") + F.hash("c", "k") % 30).alias("deep"))
    data = {"parents": parents, "children": children, "grand": grand}
    tables = {
        "parents": TableSpec({"p": ColumnSpec("id"), "kind": ColumnSpec("categorical"), "size": ColumnSpec("numerical"), "mail": ColumnSpec("email", pii=True)}, "p"),
        "children": TableSpec({"c": ColumnSpec("id"), "p": ColumnSpec("id"), "amount": ColumnSpec("numerical"), "tag": ColumnSpec("categorical")}, "c"),
        "grand": TableSpec({"c": ColumnSpec("id"), "deep": ColumnSpec("numerical")}),
    }
    edges = [Relationship("parents", "p", "children", "p"), Relationship("children", "c", "grand", "c")]
    return {n: df.cache() for n, df in data.items()}, Metadata(tables, edges)


def linked(data):
    return data["children"].join(data["parents"], "p").join(data["grand"], "c")


def test_children_depend_on_their_parents(family):
    data, metadata = family
    maker = HierarchicalSynthesizer(2)
    made = {n: df.cache() for n, df in maker.sample(maker.fit(data, metadata)).items()}
    real, like = linked(data), linked(made)
    for a, b in (("size", "amount"), ("size", "deep"), ("amount", "deep")):
        wanted, found = (x.select(F.corr(a, b)).first()[0] for x in (real, like))
        assert wanted > 0.8 and abs(found - wanted) < 0.15, (a, b)
    counted = made["children"].groupBy("p").count().join(made["parents"], "p").select(F.corr("count", "size")).first()[0]
    assert counted > 0.8
    assert abs(made["children"].count() / data["children"].count() - 1) < 0.1
    scores = {r.property: r.score for r in report.multi_table_quality_report(data, made, metadata).collect()}
    moved = made["children"].withColumn("p", (F.col("p") + 301) % 600)
    shuffled = {r.property: r.score for r in report.multi_table_quality_report(data, {**made, "children": moved}, metadata).collect()}
    # Halves of the real data have 0.91 (1,800 rows in 100 cells); the order of categories is one of hashes, so a tag follows its kind in part only.
    assert scores["inter_table_trends"] > 0.75 and scores["inter_table_trends"] > shuffled["inter_table_trends"] + 0.08
    assert report.overall(report.multi_table_diagnostic_report(data, made, metadata)) == 1.0
    assert made["parents"].join(data["parents"], "mail", "left_semi").count() == 0


def test_a_parent_with_a_third_of_the_children_and_parents_without(spark, family):
    data, metadata = family
    some = data["children"].where("p % 5 > 0").withColumn("p", F.when(F.col("c") % 3 == 0, F.lit(1)).otherwise(F.col("p")))
    maker = HierarchicalSynthesizer(3)
    two = Metadata({n: metadata.tables[n] for n in ("parents", "children")}, metadata.relationships[:1])
    made = maker.sample(maker.fit({"parents": data["parents"], "children": some}, two), 0.5)
    assert made["parents"].count() == 300
    assert report.overall(report.multi_table_diagnostic_report({"parents": data["parents"], "children": some}, made, two)) == 1.0


def test_independent_tables_get_keys_of_their_own(family):
    data, metadata = family
    maker = IndependentSynthesizer(1)
    made = maker.sample(maker.fit(data, metadata))
    assert made["children"].select("c").distinct().count() == made["children"].count() == data["children"].count()
    assert made["parents"].join(data["parents"], "mail", "left_semi").count() == 0


def test_moments_by_group_and_weight(spark):
    rows = [(i % 2, float(i), float(i * i % 7), i % 3 + 1) for i in range(50)]
    frame = spark.createDataFrame(rows, "g int, x double, y double, w int").repartition(6)
    found = moments(frame, ["x", "y"], F.col("g"), F.col("w"))
    for g in (0, 1):
        own = np.array([r[1:] for r in rows if r[0] == g])
        assert found[g].weight == own[:, 2].sum() and np.allclose(found[g].means, np.average(own[:, :2], axis=0, weights=own[:, 2]))
        assert np.allclose(found[g].covariance, np.cov(own[:, :2].T, bias=True, fweights=own[:, 2].astype(int)))
    assert moments(frame.limit(0), ["x", "y"], F.col("g")) == {}
