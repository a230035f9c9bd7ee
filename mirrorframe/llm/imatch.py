"""Document fingerprints by I-Match with randomised lexicons.

Terms whose share of documents lies within a band (so their inverse document frequency does) are kept. They are dealt
over SUBSETS random lexicons; of a text, each lexicon's sorted distinct terms are hashed. Long texts use thinner lexicons
(every second, fourth, ... term), so each hash covers about one term of a text of any length and an edit changes only
the hashes of the lexicons that it touches. A fingerprint holds two neighbouring densities, so that texts of about the same
length can be compared.

With `whole` (the registered query) near copies are one document to the band, however many there are, and a text with
fewer than FEW terms within it, and what it is compared with, are fingerprinted by all their terms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorframe.llm.native import sent_if_small, shingle_hashes, word_hashes
from mirrorframe.session import materialize

# The band: terms in at least 0.05 % and at most 10 % of the documents; inverse document frequency ln(10) to ln(2000).
LEAST_SHARE, GREATEST_SHARE = 0.0005, 0.1
SUBSETS = 64
# Texts whose least run of so many words is the same are near copies to the band, if they are this share of the rows at least.
RUN, GROUP_SHARE = 3, 0.00001
FEW = 8
_NULL_ID = -(2**63)


def lexicon(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(term): hashes of the terms within the band, counted over all texts.

    At most (mean distinct terms of a text) / LEAST_SHARE terms can be in so many texts, whatever the number of texts.
    """
    n = texts.count()
    low, high = max(1, math.ceil(LEAST_SHARE * n)), max(1, math.floor(GREATEST_SHARE * n))
    # The outer form: with the inner one the optimiser filters on the size of the arrays, and computes them there again.
    terms = texts.select(F.explode_outer(F.array_distinct(word_hashes(F.col(text_col)))).alias("term"))
    return terms.where("term is not null").groupBy("term").agg(F.count("*").alias("n")).where(F.col("n").between(low, high)).select("term")


def _group(words: Column) -> Column:
    """The least hash of a text's runs of words: of n words, an edit of one changes it with a probability of about RUN / n."""
    return F.when(F.size(words) >= RUN, F.array_min(shingle_hashes(words, RUN))).otherwise(F.xxhash64(words))


def whole_lexicon(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(term): as lexicon(), but a group of near copies is one document that has the terms of all of them.

    At most 1 / GROUP_SHARE groups are told apart from single texts, so they can be sent to all tasks. Groups of fewer rows
    (for each a fiftieth of the band's lower edge) are counted by rows.
    """
    hashed = texts.select(word_hashes(F.col(text_col)).alias("words"))
    grouped = hashed.select(_group(F.col("words")).alias("group"), F.array_distinct("words").alias("terms"))
    sizes = materialize(grouped.groupBy("group").agg(F.count("*").alias("rows")))
    n = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    large = sizes.where(F.col("rows") >= max(2, math.ceil(GROUP_SHARE * n)))
    n -= large.agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0))).first()[0]
    low, high = max(1, math.ceil(LEAST_SHARE * n)), max(1, math.floor(GREATEST_SHARE * n))
    marked = grouped.join(F.broadcast(large.select("group", F.col("group").alias("large"))), "group", "left")
    counted = marked.select("large", F.explode_outer("terms").alias("term")).where("term is not null").groupBy("term", "large").agg(F.count("*").alias("n"))
    documents = F.sum(F.when(F.col("large").isNull(), F.col("n")).otherwise(1))
    return counted.groupBy("term").agg(documents.alias("n")).where(F.col("n").between(low, high)).select("term")


def successors(ids: DataFrame) -> DataFrame:
    """`ids` (key, ...) with `next_key`, the next smaller key; after the least comes the greatest.

    Keys are range-partitioned and each slice looks ahead by itself; only one row a slice meets in one task.
    """
    sliced = materialize(ids.repartitionByRange(F.col("key").desc()).withColumn("slice", F.spark_partition_id()))
    ends = Window.orderBy(F.col("top").desc())
    tops = sliced.groupBy("slice").agg(F.max("key").alias("top"))
    after = tops.select("slice", F.lead("top").over(ends).alias("after"))
    first = tops.agg(F.max("top").alias("first"))
    inner = sliced.withColumn("next_key", F.lead("key").over(Window.partitionBy("slice").orderBy(F.col("key").desc())))
    found = inner.join(after, "slice").join(F.broadcast(first))  # one row
    return found.withColumn("next_key", F.coalesce("next_key", "after", "first")).drop("slice", "after", "first")


def density(n_terms: Column) -> Column:
    """How often the lexicons are halved for a text of so many distinct terms."""
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(n_terms, F.lit(1)) / SUBSETS))).cast("int")


def _thinned(terms: Column, mask: Column) -> Column:
    return F.filter(terms, lambda h: F.shiftright(h, 6).bitwiseAND(mask) == 0)


def _codes(terms: Column) -> Column:
    """One number for each lexicon that has any of the sorted terms: its place and 16 bits of its terms' hash."""
    places = F.array_distinct(F.transform(terms, lambda h: h.bitwiseAND(F.lit(SUBSETS - 1))))
    hashed = F.transform(places, lambda j: j * 65536 + F.xxhash64(F.filter(terms, lambda h: h.bitwiseAND(F.lit(SUBSETS - 1)) == j)).bitwiseAND(F.lit(0xFFFF)))
    return F.array_sort(hashed).cast("array<int>")


def _shown(level: Column, codes: Column, finer: Column) -> Column:
    text = lambda c: F.concat_ws("", F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")))
    return F.concat_ws(":", level.cast("string"), text(codes), text(finer))


def _identity(level: Column, codes: Column, finer: Column, text_hash: Column) -> Column:
    """What the shown fingerprint says, as a struct: equal for equal fingerprints and only for them."""
    some = F.size(codes) > 0
    return F.struct(F.when(some, level).otherwise(-1).alias("level"), codes.alias("codes"), finer.alias("finer"), F.when(some, 0).otherwise(text_hash).alias("text"))


def displayed(side: str, whole: bool) -> Column:
    """The fingerprint as text, from a row's columns of that side; without terms, a hash of the text itself."""
    c = lambda name: F.col(f"{side}_{name}")
    plain = _shown(c("level"), c("codes"), c("finer"))
    seen = F.when(F.size(c("codes")) > 0, plain)
    if whole:
        by_all = F.concat(F.lit("+"), _shown(c("level"), c("wide"), c("wide_finer")))
        seen = F.when(~c("few"), plain).when(F.size(c("wide")) > 0, by_all)
    return seen.otherwise(F.concat(F.lit("="), F.lower(F.hex(c("hash")))))


def likeness(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Share of the lexicons used by either text whose hashes agree, at a density that both have.

    Arguments are FIELDS. Equal fingerprints have 1; without a common density it is 0.
    """

    def share(x: Column, y: Column) -> Column:
        place = lambda c: F.transform(c, lambda v: F.shiftright(v, 16))
        used = F.size(F.array_union(place(x), place(y)))
        return F.when(used > 0, F.size(F.array_intersect(x, y)) / used).otherwise(F.lit(0.0))

    (la, ca, fa, ha), (lb, cb, fb, hb) = a, b
    return (
        F.when(_identity(la, ca, fa, ha).eqNullSafe(_identity(lb, cb, fb, hb)), F.lit(1.0)).when(la == lb, share(ca, cb)).when(la + 1 == lb, share(fa, cb))
        .when(lb + 1 == la, share(ca, fb)).otherwise(F.lit(0.0))
    )


FIELDS, WHOLE_FIELDS = ("level", "codes", "finer", "hash"), ("few", "wide", "wide_finer")


def whole_likeness(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """likeness(), by all terms if either text has few within the band. Arguments are FIELDS and WHOLE_FIELDS."""
    (la, ca, fa, ha, few_a, wa, wfa), (lb, cb, fb, hb, few_b, wb, wfb) = a, b
    return F.when(few_a | few_b, likeness((la, wa, wfa, ha), (lb, wb, wfb, hb))).otherwise(likeness((la, ca, fa, ha), (lb, cb, fb, hb)))


def fingerprints(texts: DataFrame, keys: list[str], own: str, other: str, terms: DataFrame, whole: bool = False) -> DataFrame:
    """`keys` and, for the texts in the columns `own` and `other`, FIELDS, as `own_...` and `other_...`.

    Rows with equal keys give as many equal rows. A text without terms in the lexicon is fingerprinted as a whole; with `whole`,
    one with fewer than FEW by all its terms, marked by a plus sign, and WHOLE_FIELDS are given as well (those by all
    terms of `other` only if they are needed). displayed() makes the texts of them; they are not stored.
    `texts` should already be dealt by one of the keys; then nothing is moved.
    """
    hashed = texts.select(
        *keys, F.array_distinct(word_hashes(F.col(own))).alias("own_terms"), F.array_distinct(word_hashes(F.col(other))).alias("other_terms"),
        F.xxhash64(own).alias("own_hash"), F.xxhash64(other).alias("other_hash"),
    )
    levels = hashed.withColumns({f"{s}_level": density(F.size(f"{s}_terms")) for s in ("own", "other")})
    masks = levels.withColumns({f"{s}_mask": F.expr(f"shiftleft(1L, {s}_level) - 1") for s in ("own", "other")})
    fixed = [*keys, "own_level", "other_level", "own_hash", "other_hash", "n_own"]
    thin = masks.withColumns({f"{s}_terms": _thinned(F.col(f"{s}_terms"), F.col(f"{s}_mask")) for s in ("own", "other")}).withColumn("n_own", F.size("own_terms"))
    # A last element that every lexicon has stands for the row itself.
    row = F.array(F.lit(0).cast("long"))
    single = thin.select(*fixed, F.posexplode_outer(F.concat("own_terms", "other_terms", row)).alias("at", "term"))
    known = terms.unionByName(terms.sparkSession.range(1).select(F.col("id").alias("term"))).distinct()
    if whole:
        kept = single.join(sent_if_small(known.withColumn("inside", F.lit(True))), "term", "left")
    else:
        kept = single.join(sent_if_small(known), "term", "left_semi").withColumn("inside", F.lit(True))
    mine, its = (F.col("term") != 0) & (F.col("at") < F.col("n_own")), (F.col("term") != 0) & (F.col("at") >= F.col("n_own"))
    sets = {"own_kept": mine & F.col("inside"), "other_kept": its & F.col("inside")} | ({"own_all": mine, "other_all": its} if whole else {})
    grouped = kept.groupBy(*fixed).agg(
        *[F.array_sort(F.collect_set(F.when(of, F.col("term")))).alias(name) for name, of in sets.items()],
        F.count(F.when(F.col("term") == 0, 1)).cast("int").alias("copies"),
    )
    out = grouped
    if whole:
        out = out.withColumns({f"{s}_few": F.size(f"{s}_kept") < FEW for s in ("own", "other")})
    for s in ("own", "other"):
        finer = _thinned(F.col(f"{s}_kept"), F.expr(f"shiftleft(1L, {s}_level + 1) - 1"))
        out = out.withColumns({f"{s}_codes": _codes(F.col(f"{s}_kept")), f"{s}_finer": _codes(finer)})
        if whole:
            finer = _thinned(F.col(f"{s}_all"), F.expr(f"shiftleft(1L, {s}_level + 1) - 1"))
            needed = F.lit(True) if s == "own" else F.col("own_few") | F.col("other_few")
            out = out.withColumns({f"{s}_wide": F.when(needed, _codes(F.col(f"{s}_all"))), f"{s}_wide_finer": F.when(needed, _codes(finer))})
    columns = [f"{s}_{c}" for s in ("own", "other") for c in FIELDS + WHOLE_FIELDS * whole]
    return out.select(*keys, *columns, F.explode(F.array_repeat(F.lit(0), F.greatest("copies", F.lit(1)))).alias("_copy")).drop("_copy")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of `docs`.

    The edited text has its last third replaced by the beginning of the next document, in descending order of the ids, the
    first after the last. A null text is empty. A null id counts as the least possible one. Rows that repeat an id
    are one document to their predecessor, with the least of its texts; each gets a row of its own. Other columns
    are ignored. `whole`: see the module's text; without it, copies count as often as there are rows of them.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    terms = materialize(whole_lexicon(base) if whole else lexicon(base))
    fields, alike = (FIELDS + WHOLE_FIELDS, whole_likeness) if whole else (FIELDS, likeness)
    ids = base.groupBy("key").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("rows"))
    ring = materialize(successors(ids))
    repeated = not ring.where("rows > 1").isEmpty()
    wanted = ring.select(F.col("next_key").alias("key"), F.col("key").alias("to"), F.floor(F.col("n") / 3).cast("int").alias("need"))
    heads = base.join(wanted, "key").select(F.col("to").alias("key"), F.col("key").alias("next_key"), F.expr("substring(text, 1, need)").alias("head"))
    if repeated:
        heads = heads.groupBy("key", "next_key").agg(F.min("head").alias("head"))
    joined = base.join(heads, "key").withColumn("n_chars", F.length("text").cast("long"))
    edited = joined.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), substring(head, 1, cast(n_chars div 3 as int)))"))
    keyed = edited.select("key", "next_key", "n_chars", F.unhex(F.sha2("edited", 256)).alias("edited_sha256"), F.xxhash64("text").alias("same"), "text", "edited")
    keys = ["key", "next_key", "n_chars", "edited_sha256", "same"]
    marked = materialize(fingerprints(keyed, keys, "text", "edited", terms, whole))
    nexts = marked.select(F.col("key").alias("next_key"), *[F.col(f"own_{c}").alias(f"next_{c}") for c in fields])
    if repeated:
        nexts = nexts.groupBy("next_key").agg(*[F.min_by(c, displayed("next", whole)).alias(c) for c in nexts.columns[1:]])
    of = lambda s: tuple(F.col(f"{s}_{c}") for c in fields)
    return marked.join(nexts, "next_key").select(
        F.when(F.col("key") != _NULL_ID, F.col("key")).alias("doc_id"), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), displayed("own", whole).alias("fingerprint"),
        displayed("other", whole).alias("edited_fingerprint"), alike(of("own"), of("other")).alias("near_edited"), alike(of("own"), of("next")).alias("near_next"),
    )
