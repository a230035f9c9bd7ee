"""SQL equivalents of the metric and profile queries."""

from itertools import combinations

from oracles.results import CATALOG, COLUMN_COUNTS, DEPTH, EDGES, PROFILE

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]
SIDES = "sides as (select *, l_orderkey % 2 = 0 as is_real, cast(epoch_us(l_shipdate) as double) as ship from lineitem)"


def long(columns, cast, source="sides", alias=None):
    alias = alias or {}
    return " union all ".join(
        f"select '{c}' as col, cast({alias.get(c, c)} as {cast}) as v, is_real from {source}" for c in columns)


def ks(source):
    """KS complement per column over (col, v, is_real) rows."""
    return f"""select col, 1.0 - max(abs(cr / tr - cs / ts)) as score from (
 select col, cast(sum(nr) over (partition by col order by v) as double) as cr, cast(sum(ns) over (partition by col order by v) as double) as cs,
  cast(sum(nr) over (partition by col) as double) as tr, cast(sum(ns) over (partition by col) as double) as ts
 from (select col, v, count(*) filter (is_real) as nr, count(*) filter (not is_real) as ns from ({source}) where v is not null group by 1, 2)) group by 1"""


def tv(source):
    return f"""select col, 1.0 - sum(abs(cast(nr as double) / tr - cast(ns as double) / ts)) / 2 as score from (
 select col, nr, ns, sum(nr) over (partition by col) as tr, sum(ns) over (partition by col) as ts
 from (select col, v, count(*) filter (is_real) as nr, count(*) filter (not is_real) as ns from ({source}) where v is not null group by 1, 2)) group by 1"""


def bin_of(column, lo, hi):
    return f"""case when {column} is null then null when {column} < {lo} then 0 when {column} > {hi} then 11
 else cast(least(floor(({column} - {lo}) / (({hi} - {lo}) / 10)), 9) as int) + 1 end"""


def bounds(columns, source, alias=None):
    alias = alias or {}
    return "bounds as (select " + ", ".join(
        f"min({alias.get(c, c)}) as lo_{c}, max({alias.get(c, c)}) as hi_{c}" for c in columns) + f" from {source})"


def cut(texts, numbers, source="sides", alias=None):
    alias = alias or {}
    return "cut as (select is_real, " + ", ".join(
        [*[f"cast({c} as varchar) as {c}" for c in texts],
         *[f"cast({bin_of(alias.get(c, c), f'lo_{c}', f'hi_{c}')} as varchar) as {c}_b" for c in numbers]]) + f" from {source} cross join bounds)"


def pair_tv(pairs, numbers):
    name = {c: f"{c}_b" for c in numbers}
    rows = " union all ".join(
        f"select '{a}' as column_a, '{b}' as column_b, {name.get(a, a)} as va, {name.get(b, b)} as vb, is_real from cut" for a, b in pairs)
    return f"""select column_a, column_b, 1.0 - sum(abs(cast(nr as double) / tr - cast(ns as double) / ts)) / 2 as score from (
 select column_a, column_b, nr, ns, sum(nr) over (partition by column_a, column_b) as tr, sum(ns) over (partition by column_a, column_b) as ts
 from (select column_a, column_b, va, vb, count(*) filter (is_real) as nr, count(*) filter (not is_real) as ns from ({rows}) group by all)) group by 1, 2"""


def correlations(pairs, alias=None):
    alias = alias or {}
    return " union all ".join(
        f"select '{a}' as column_a, '{b}' as column_b, 1.0 - abs(corr({alias.get(a, a)}, {alias.get(b, b)}) filter (is_real) - corr({alias.get(a, a)}, {alias.get(b, b)}) filter (not is_real)) / 2 as score from sides"
        for a, b in pairs)


SHIP = {"l_shipdate": "ship"}
SHAPES = NUMERIC + ["l_shipdate"]
ALL = [*CATEGORICAL, *SHAPES]
MIXED_PAIRS = [(a, b) for a, b in combinations(ALL, 2) if not (a in SHAPES and b in SHAPES)]
# The report takes columns in table order.
REPORT = f"""with {SIDES}, {bounds(SHAPES, 'sides where is_real', SHIP)}, {cut(CATEGORICAL, SHAPES, alias=SHIP)},
 scores as (
 select 'column_shapes' as property, score from ({ks(long(SHAPES, 'double', alias=SHIP))})
 union all select 'column_shapes', score from ({tv(long(CATEGORICAL, 'varchar'))})
 union all select 'column_pair_trends', score from ({correlations(list(combinations(SHAPES, 2)), SHIP)})
 union all select 'column_pair_trends', score from ({pair_tv(MIXED_PAIRS, SHAPES)})),
 properties as (select property, avg(score) as score from scores group by 1)
 select property, round(score, 6) as score from properties union all select 'overall', round(avg(score), 6) from properties"""


def inside(c, expression):
    return f"select '{c}' as col, avg(case when {expression} between (select min({expression}) from sides where is_real) and (select max({expression}) from sides where is_real) then 1.0 else 0.0 end) as score from sides where not is_real"


BOUNDARY = " union all ".join(inside(c, SHIP.get(c, c)) for c in SHAPES)
CATEGORY = " union all ".join(
    f"select '{c}' as col, avg(case when {c} in (select {c} from sides where is_real) then 1.0 else 0.0 end) as score from sides where not is_real"
    for c in CATEGORICAL)


def mi(pairs, numbers):
    name = {c: f"{c}_b" for c in numbers}
    rows = " union all ".join(
        f"select '{a}' as column_a, '{b}' as column_b, {name.get(a, a)} as va, {name.get(b, b)} as vb from cut" for a, b in pairs)
    return f"""select column_a, column_b, round(sum(n / t * ln(n * t / (na * nb))), 6) as mutual_information from (
 select column_a, column_b, cast(n as double) as n, cast(sum(n) over (partition by column_a, column_b) as double) as t,
  cast(sum(n) over (partition by column_a, column_b, va) as double) as na, cast(sum(n) over (partition by column_a, column_b, vb) as double) as nb
 from (select column_a, column_b, va, vb, count(*) as n from ({rows}) group by all)) group by 1, 2"""


MATCHED = ["l_quantity", "l_discount", "l_tax"]

STAR_CATEGORIES = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"]}
STAR_NUMBERS = {
    "region": 0, "nation": 0, "customer": 1, "supplier": 1, "part": 2, "orders": 2, "lineitem": 6}
_validity = sum(len(v) for v in STAR_CATEGORIES.values()) + sum(STAR_NUMBERS.values()) + 6

SQL = {
    "ks_complement": f"with {SIDES} select col as \"column\", round(score, 6) as score from ({ks(long(SHAPES, 'double', alias=SHIP))})",
    "tv_complement": f"with {SIDES} select col as \"column\", round(score, 6) as score from ({tv(long(CATEGORICAL, 'varchar'))})",
    "chi_square_stat": f"""with {SIDES}, counts as (select col, v, count(*) filter (is_real) as nr, count(*) filter (not is_real) as ns from ({long([*CATEGORICAL, 'l_linenumber'], 'varchar')}) group by 1, 2),
 totals as (select *, cast(sum(nr) over (partition by col) as double) as tr, cast(sum(ns) over (partition by col) as double) as ts from counts),
 expected as (select *, tr * (nr + ns) / (tr + ts) as er, ts * (nr + ns) / (tr + ts) as es from totals)
 select col as "column", round(sum(pow(nr - er, 2) / er + pow(ns - es, 2) / es), 6) as statistic, count(*) - 1 as dof from expected group by 1""",
    "correlation_similarity": f"with {SIDES} select column_a, column_b, round(score, 6) as score from ({correlations(list(combinations(NUMERIC, 2)))})",
    "contingency_similarity": f"with {SIDES}, {bounds(NUMERIC, 'sides where is_real')}, {cut(CATEGORICAL, NUMERIC)} select column_a, column_b, round(score, 6) as score from ({pair_tv(list(combinations([*CATEGORICAL, *NUMERIC], 2)), NUMERIC)})",
    "quality_report": REPORT,
    "boundary_adherence": f"with {SIDES} select col as \"column\", round(score, 6) as score from ({BOUNDARY})",
    "diagnostic_report": f"""with {SIDES}, properties as (select 'data_validity' as property, avg(score) as score from ({BOUNDARY} union all {CATEGORY}) union all select 'data_structure', 1.0)
 select property, round(score, 6) as score from properties union all select 'overall', round(avg(score), 6) from properties""",
    "category_adherence": """with real as (select * from part where p_size % 4 = 0 and p_partkey % 3 = 0), made as (select * from part where not (p_size % 4 = 0 and p_partkey % 3 = 0))
 select 'p_name' as "column", round(avg(case when p_name in (select p_name from real) then 1.0 else 0.0 end), 6) as score from made
 union all select 'p_brand', round(avg(case when p_brand in (select p_brand from real) then 1.0 else 0.0 end), 6) from made
 union all select 'p_type', round(avg(case when p_type in (select p_type from real) then 1.0 else 0.0 end), 6) from made""",
    "key_uniqueness": "select 'l_orderkey' as \"column\", round(cast(count(distinct l_orderkey) as double) / count(*), 6) as score from lineitem",
    "referential_integrity": "select 'o_custkey' as \"column\", round(avg(case when o_custkey in (select c_custkey from customer where c_nationkey % 3 <> 0) then 1.0 else 0.0 end), 6) as score from orders",
    "cardinality_shape": f"""with a as (select o_orderkey, count(l_orderkey) as v from orders left join (select * from lineitem where l_orderkey % 2 = 0) on l_orderkey = o_orderkey group by 1),
 b as (select o_orderkey, count(l_orderkey) as v from (select * from orders where o_custkey % 3 = 0) left join lineitem on l_orderkey = o_orderkey group by 1)
 select col as "column", round(score, 6) as score from ({ks("select 'l_orderkey' as col, v, true as is_real from a union all select 'l_orderkey', v, false from b")})""",
    "structure": f"""with {CATALOG}, {CATALOG.replace('catalog_v as', 'half_v as').replace('from lineitem', 'from lineitem where l_orderkey % 2 = 0')},
 shared as (select dataset, table_name, column_name, sdtype from catalog_v intersect select dataset, table_name, column_name, sdtype from half_v),
 every as (select dataset, table_name, column_name, sdtype from catalog_v union select dataset, table_name, column_name, sdtype from half_v)
 select e.dataset, round(cast((select count(*) from shared s where s.dataset = e.dataset) as double) / count(*), 6) as score from every e group by 1""",
    "new_row_synthesis": f"""with {SIDES}, {bounds(MATCHED, 'sides where is_real')}, known as (select distinct l_returnflag, l_linestatus, {', '.join(MATCHED)} from sides where is_real),
 made as (select l_returnflag, l_linestatus, {', '.join(MATCHED)}, count(*) as n from sides where not is_real group by all),
 hit as (select distinct m.* from made m join known k on m.l_returnflag = k.l_returnflag and m.l_linestatus = k.l_linestatus cross join bounds where {' and '.join(f'abs(m.{c} - k.{c}) <= (hi_{c} - lo_{c}) * 0.01' for c in MATCHED)})
 select round(1.0 - cast((select coalesce(sum(n), 0) from hit) as double) / sum(n), 6) as score from made""",
    "multi_table_diagnostic": f"""with kept as (select * from customer where c_nationkey % 3 <> 0),
 properties as (
 select 'data_validity' as property, 1.0 as score union all select 'data_structure', 1.0
 union all select 'relationship_validity', (6.0 + (select avg(case when o_custkey in (select c_custkey from kept) then 1.0 else 0.0 end) from orders)) / 7)
 select property, round(cast(score as double), 6) as score from properties union all select 'overall', round(avg(score), 6) from properties""",
    "mutual_information": f"with sides as (select *, true as is_real from lineitem), {bounds(NUMERIC, 'sides')}, {cut(CATEGORICAL, NUMERIC)} {mi(list(combinations([*CATEGORICAL, *NUMERIC], 2)), NUMERIC)}",
    "sequence_features": """with timed as (select user_id as key, epoch_us(ts) as t, value as v, min(epoch_us(ts)) over (partition by user_id) as t0, max(epoch_us(ts)) over (partition by user_id) as t1 from events),
 placed as (select key, v, cast(t - t0 as double) / cast(greatest(t1 - t0, 1) as double) * 4 as x from timed)
 select key, cast(least(floor(x), 3) as int) as "interval", round(avg(v), 6) as mean, round(stddev_pop(v), 6) as sd, round(regr_slope(v, x), 6) as slope, count(*) as n from placed group by 1, 2""",
    "random_interval_features": """with timed as (select user_id as key, epoch_us(ts) as t, round(value * 100) as v, min(epoch_us(ts)) over (partition by user_id) as t0, max(epoch_us(ts)) over (partition by user_id) as t1
  from events where ts is not null and value is not null),
 placed as (select key, v, cast(t - t0 as double) / cast(greatest(t1 - t0, 1) as double) as x from timed),
 parted as (select *, least(floor(x * 64), 63) as part from placed), intervals(i, a, b) as (values (0, 38, 52), (1, 36, 46), (2, 22, 34), (3, 2, 14), (4, 30, 48), (5, 32, 52), (6, 40, 64), (7, 16, 50))
 select k.key, i as "interval", count(p.v) as n, round(avg(p.v), 6) as mean, round(stddev_pop(p.v), 6) as sd, case when var_pop(p.x) * count(p.v) > 1e-18 then round(regr_slope(p.v, p.x), 3) end as slope
 from (select distinct key from parted) k cross join intervals left join parted p on p.key = k.key and part >= a and part < b group by 1, 2""",
    "metadata_counts": f"""with {CATALOG}, {COLUMN_COUNTS} select dataset, count(*) as Num_Tables, cast(sum(n) as bigint) as Total_Num_Columns, cast(sum(cat) as bigint) as Total_Num_Columns_Categorical,
 cast(sum(num) as bigint) as Total_Num_Columns_Numerical, cast(sum(dt) as bigint) as Total_Num_Columns_Datetime, cast(sum(pii) as bigint) as Total_Num_Columns_PII,
 cast(sum(idn) as bigint) as Total_Num_Columns_ID_NonKey, max(n) as Max_Num_Columns_Per_Table from per_table group by 1""",
    "relationships": f"with {EDGES}, p as (select dataset, parent_table, count(*) as n from edges_v group by 1, 2) select dataset, cast(sum(n) as bigint) as Num_Relationships, max(n) as Max_Schema_Branch from p group by 1",
    "schema_depth": f"with recursive {CATALOG}, {EDGES}, {DEPTH} select c.dataset, cast(coalesce(max(depth), 1) as bigint) as Max_Schema_Depth from (select distinct dataset from catalog_v) c left join chain on chain.dataset = c.dataset group by 1",
    "row_counts": "select concat('d', cast(l_partkey % 12 as varchar)) as dataset, concat('t', cast(l_suppkey % 5 as varchar)) as table_name, count(*) as num_rows from lineitem group by 1, 2",
    "dataset_rows": """with n as (select count(*) as n from region union all select count(*) from nation union all select count(*) from customer union all select count(*) from supplier
 union all select count(*) from part union all select count(*) from orders union all select count(*) from lineitem)
 select 'star' as dataset, cast(sum(n) as bigint) as Total_Num_Rows, max(n) as Max_Num_Rows_Per_Table from n""",
    "dataset_summary": f"{PROFILE} select * from profile",
    "dataset_size": "select round(cast(sum(coalesce(strlen(text), 0) + coalesce(strlen(lang), 0) + coalesce(strlen(source), 0) + case when doc_id is null then 0 else 8 end + case when n_chars is null then 0 else 8 end) as double) / 1000000.0, 6) as size_MB from documents",
    "dataset_summary_filter": """with n as (select concat('d', cast(l_partkey % 12 as varchar)) as dataset, l_suppkey % 5 as t, count(*) as n from lineitem where l_partkey % 12 in (1, 2, 9) group by 1, 2)
 select dataset, cast(sum(n) as bigint) as Total_Num_Rows, max(n) as Max_Num_Rows_Per_Table from n group by 1""",
}
