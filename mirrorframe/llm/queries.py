"""The registered queries on corpora: each applies one operator with production parameters to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.llm import containment, gam, hyperdim, imatch, merkle, minmax, packing, phrases, simhash, tokens, toxicity, urls, whitening

# The rules of the URL query.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_minmax_near_dedup(spark, sf_dir):
    return minmax.near_duplicates(table(spark, sf_dir, "documents"), width=4)


@query
def op6_suffix_array_dedup(spark, sf_dir):
    return phrases.removals(table(spark, sf_dir, "documents")).drop("kept")


@query
def op1_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query
def op9_minimum_slack_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op2_hyperdimensional_language(spark, sf_dir):
    return hyperdim.predict_languages(table(spark, sf_dir, "documents"))


@query
def op4_quality_gam(spark, sf_dir):
    return gam.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_toxicity_pu(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_url_logistic_filter(spark, sf_dir):
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


@query
def op3_minhash_containment(spark, sf_dir):
    return containment.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_imatch_fingerprints(spark, sf_dir):
    return imatch.compared(table(spark, sf_dir, "documents"), whole=True)


@query
def op11_embedding_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query
def op12_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


@query
def op13_golay_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


SQL["op3_minhash_containment"] = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents
), i as (
  select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark
), sized as (select item_id, w, least(5, len(w)) as k from i where len(w) > 0),
item as (
  select distinct item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') as shingle
  from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as s from sized)
), total as (select item_id, count(*) as n_item from item group by item_id),
doc as (
  select distinct doc_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') as shingle
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as s from d, (select distinct k from sized) where len(w) >= k)
)
select doc_id, item_id, cast(n_item as integer) as n_item, cast(count(*) as integer) as n_shared, count(*) / n_item as containment
from doc join item using (k, shingle) join total using (item_id)
group by doc_id, item_id, n_item having 100 * count(*) >= 80 * n_item
"""

SQL["op12_merkle_manifest"] = r"""
with recursive base as (
  select doc_id, coalesce('=' || lang, '') as tree,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
    n_chars, coalesce(strlen(text) || ':' || text, '-') as tail,
    xor(list_reduce([4294967295::bigint] || flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [256 + ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0, 0])),
      lambda a, e: case when e > 0 then xor(a, e - 256) else xor(a >> 1, case when a & 1 = 1 then 3988292384 else 0 end) end), 4294967295) as crc
  from documents
), leaves as (
  select doc_id, tree, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
    sha256(head || coalesce(strlen((n_chars + (crc % 7 = 0)::int)::varchar) || ':' || (n_chars + (crc % 7 = 0)::int), '-') || tail) as start
  from base
), placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by tree) as n from leaves
), node as (
  select tree, 0 as lvl, idx, n, leaf as d from placed
  union all
  select tree, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(d, '' order by idx)) from node where n > 1 group by tree, lvl, idx // 2, n
), sub as (
  select tree, d as subroot, row_number() over (order by tree) - 1 as idx, count(*) over () as n from node where n = 1
), over_langs as (
  select 0 as lvl, idx, n, subroot as d from sub
  union all
  select lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(d, '' order by idx)) from over_langs where n > 1 group by lvl, idx // 2, n
), climb as (
  select doc_id, leaf, tree, 0 as lvl, idx, n, start as f, '' as proof from placed
  union all
  select doc_id, leaf, climb.tree, climb.lvl + 1, climb.idx // 2, (climb.n + 1) // 2,
    sha256(case when node.d is null then f when climb.idx % 2 = 0 then f || node.d else node.d || f end), proof || coalesce(node.d, '')
  from climb left join node on node.tree = climb.tree and node.lvl = climb.lvl and node.idx = xor(climb.idx, 1) where climb.n > 1
), further as (
  select doc_id, leaf, sub.subroot, 0 as lvl, sub.idx, sub.n, f, proof from climb join sub using (tree) where climb.n = 1
  union all
  select doc_id, leaf, subroot, further.lvl + 1, further.idx // 2, (further.n + 1) // 2,
    sha256(case when o.d is null then f when further.idx % 2 = 0 then f || o.d else o.d || f end), proof || coalesce(o.d, '')
  from further left join over_langs o on o.lvl = further.lvl and o.idx = xor(further.idx, 1) where further.n > 1
)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, f as folded_root, f = root as verified
from further, (select d as root from over_langs where n = 1) where n = 1
"""
