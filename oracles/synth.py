"""SQL equivalents of the synthesizer and subset queries."""


def uniform(seed, stream, counter):
    return f"(cast(cast(concat('0x', substr(md5(concat('{seed}|{stream}|', cast({counter} as varchar))), 1, 13)) as bigint) as double) / 4503599627370496.0)"


def index(seed, stream, counter, size):
    return f"cast(floor({uniform(seed, stream, counter)} * cast({size} as double)) as bigint)"


def ids(table, scale=""):
    return f"(select unnest(range(cast(count(*){scale} as bigint))) as id from {table})"


def domain(table, column):
    return f"(select v, row_number() over (order by md5(v)) - 1 as i, count(*) over () as k from (select distinct {column} as v from {table}))"


def frequency(table, column):
    """Values with their ranges in hash order."""
    return f"""(select v, cast(sum(n) over (order by md5(v) rows between unbounded preceding and current row) as bigint) - n as a,
 cast(sum(n) over (order by md5(v) rows between unbounded preceding and current row) as bigint) as b, cast(sum(n) over () as bigint) as total
 from (select {column} as v, count(*) as n from {table} group by 1))"""


def real(seed, column, i="id"):
    return f"round(lo_{column} + {uniform(seed, column, i)} * (hi_{column} - lo_{column}), 6) as {column}"


LINE_REALS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_bounds = ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in LINE_REALS)

MIXED = """mixed as (
 select l_orderkey, l_partkey, l_suppkey, nullif(l_linenumber, 7) as line, case when l_discount > 0.02 then l_discount end as discount,
  nullif(l_returnflag, 'R') as flag, l_linestatus as status, epoch_us(date_trunc('day', l_shipdate)) as shipped from lineitem),
means as (select avg(line) as m_line, avg(discount) as m_discount from mixed),
flags as (select v, row_number() over (order by v) - 1 as i from (select distinct coalesce(flag, '__nan__') as v from mixed)),
states as (select v, row_number() over (order by v) - 1 as i from (select distinct coalesce(status, '__nan__') as v from mixed)),
snapped as (select distinct coalesce(cast(line as double), m_line) as v from mixed, means)"""



def network(seed, stream):
    """One pass of a number v through the four rounds over the moduli a and b; as a select from a relation with v, a and b."""
    shift = lambda k, number, size: index(seed, f"{stream}#{k}", number, size)
    return (f"select *, l4 + a * r4 as w from (select *, r3 as l4, (l3 + {shift(3, 'r3', 'b')}) % b as r4 from (select *, r2 as l3, (l2 + {shift(2, 'r2', 'a')}) % a as r3"
            f" from (select *, r1 as l2, (l1 + {shift(1, 'r1', 'b')}) % b as r2 from (select *, r0 as l1, (l0 + {shift(0, 'r0', 'a')}) % a as r1"
            " from (select *, v % a as l0, v // a as r0 from ({rel}))))))")


def permuted(seed, stream, name):
    """Common tables `name`: (id, v), the place of each customer's key under the permutation of their number."""
    net = network(seed, stream)
    return (f"{name}_walk as (select id, w as v from ({net.replace('{rel}', 'select c_custkey as id, c_custkey as v, a, b from customer, m')}) union all "
            f"select id, w from ({net.replace('{rel}', f'select id, v, a, b from {name}_walk, m where v >= n')})), {name} as (select id, v from {name}_walk, m where v < n)")


# The root of n and the moduli near it whose product exceeds n least.
MODULI = """c as (select count(*) as n, cast(floor(sqrt(count(*) - 1)) as bigint) + 1 as root from customer),
m as (select n, a, b from (select n, a, cast(ceil(n / a) as bigint) as b from (select n, unnest(range(root, root + least(root, 256))) as a from c)) order by a * b - n, a limit 1)"""

# Four small letters, then four digits, from the number's highest place on.
_letter = "substr('abcdefghijklmnopqrstuvwxyz', cast((x // {size}) % 26 as int) + 1, 1)"
_sizes = [26**k * 10**4 for k in (3, 2, 1, 0)]
EMAIL = "concat('user.', " + ", ".join(_letter.replace("{size}", str(size)) for size in _sizes) + ", lpad(cast(x % 10000 as varchar), 4, '0'), '@example.com')"

CAP = "md5(concat('{seed}|', {keys}))"

SQL = {
    "identity_sample": "select * from supplier",
    "uniform_sample": f"""with bounds as (select min(l_linenumber) as lo_n, max(l_linenumber) as hi_n, {_bounds},
  epoch_us(min(l_shipdate)) as lo_t, epoch_us(max(l_shipdate)) as hi_t from lineitem),
 flags as {domain('lineitem', 'l_returnflag')}, states as {domain('lineitem', 'l_linestatus')},
 drawn as (select id, cast(lo_n + {index(7, 'l_linenumber', 'id', 'hi_n - lo_n + 1')} as int) as l_linenumber,
  {', '.join(real(7, c) for c in LINE_REALS)},
  cast(floor(lo_t + {uniform(7, 'l_shipdate', 'id')} * (hi_t - lo_t)) as bigint) as l_shipdate,
  {index(7, 'l_returnflag', 'id', '(select max(k) from flags)')} as f, {index(7, 'l_linestatus', 'id', '(select max(k) from states)')} as s
  from {ids('lineitem')} cross join bounds)
 select id, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, flags.v as l_returnflag, states.v as l_linestatus, l_shipdate
 from drawn join flags on flags.i = f join states on states.i = s""",
    "uniform_multi_table": f"""with names as {domain('customer', 'c_name')}, prios as {domain('orders', 'o_orderpriority')},
 cb as (select min(c_custkey) as lo_k, max(c_custkey) as hi_k, min(c_acctbal) as lo_v, max(c_acctbal) as hi_v from customer),
 ob as (select min(o_orderkey) as lo_k, max(o_orderkey) as hi_k, min(o_totalprice) as lo_v, max(o_totalprice) as hi_v from orders),
 c as (select lo_k + {index('3.customer', 'c_custkey', 'id', 'hi_k - lo_k + 1')} as key, round(lo_v + {uniform('3.customer', 'c_acctbal', 'id')} * (hi_v - lo_v), 6) as amount,
  {index('3.customer', 'c_name', 'id', '(select max(k) from names)')} as t from {ids('customer', ' * 0.5')} cross join cb),
 o as (select lo_k + {index('3.orders', 'o_orderkey', 'id', 'hi_k - lo_k + 1')} as key, round(lo_v + {uniform('3.orders', 'o_totalprice', 'id')} * (hi_v - lo_v), 6) as amount,
  {index('3.orders', 'o_orderpriority', 'id', '(select max(k) from prios)')} as t from {ids('orders', ' * 0.5')} cross join ob)
 select 'customer' as table_name, key, v as text, amount from c join names on i = t
 union all select 'orders', key, v, amount from o join prios on i = t""",
    "column_resample": f"""with a as {frequency('part', 'p_name')}, b as {frequency('part', 'p_brand')}, c as {frequency('part', 'p_type')},
 drawn as (select id, {index(5, 'p_name', 'id', '(select max(total) from a)')} as x, {index(5, 'p_brand', 'id', '(select max(total) from a)')} as y,
  {index(5, 'p_type', 'id', '(select max(total) from a)')} as z from {ids('part')})
 select id, a.v as p_name, b.v as p_brand, c.v as p_type from drawn
 join a on x >= a.a and x < a.b join b on y >= b.a and y < b.b join c on z >= c.a and z < c.b""",
    "bootstrap_rows": f"""with numbered as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  row_number() over (order by md5(cast(o_orderkey as varchar)), cast(o_orderkey as varchar)) - 1 as n from orders)
 select id, o_orderkey, o_custkey, o_orderstatus, o_totalprice from {ids('orders')}
 join numbered on n = {index(11, 'bootstrap', 'id', '(select count(*) from orders)')}""",
    "label_sample": f"""with f as {frequency('documents', 'lang')},
 drawn as (select id, {index(13, 'lang', 'id', '(select max(total) from f)')} as d from {ids('documents')})
 select id, v as lang from drawn join f on d >= a and d < b""",
    "mixed_encode": f"""with {MIXED} select l_orderkey, l_partkey, l_suppkey, round(coalesce(line, m_line), 6) as line, round(coalesce(discount, m_discount), 6) as discount,
 f.i as flag, s.i as status, round(cast(shipped as double), 0) as shipped
 from mixed cross join means join flags f on f.v = coalesce(flag, '__nan__') join states s on s.v = coalesce(status, '__nan__')""",
    "mixed_decode": f"""with {MIXED} select l_orderkey, l_suppkey,
 cast(round_even(coalesce(line, m_line) + 0.4, 0) as int) as line,
 round(coalesce(discount, m_discount), 6) as discount, flag, status,
 strftime(make_timestamp(shipped), '%d %b %Y') as shipped,
 row_number() over (order by l_orderkey, l_suppkey, coalesce(line, m_line), coalesce(discount, m_discount), coalesce(flag, '__nan__'), coalesce(status, '__nan__'), shipped) - 1 as l_partkey
 from mixed cross join means""",
    "surrogate_keys": f"""with recursive {MODULI}, {permuted(21, 'key', 'k')}, {permuted(22, 'mail', 'e')}
 select c_custkey, k.v as surrogate, {EMAIL} as email, c_mktsegment
 from customer join k on k.id = c_custkey join (select id, v * ({26**4 * 10**4} // (select n from m)) as x from e) e on e.id = c_custkey""",
    "row_cap": f"""select o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) as o_orderdate, o_orderpriority from orders
 order by {CAP.format(seed=2, keys='cast(o_orderkey as varchar)')}, o_orderkey limit 1000""",
    "column_trim": "select l_suppkey, l_orderkey, l_partkey, l_linenumber, l_quantity from lineitem",
    "sequence_trim": f"""select epoch_us(ts) as ts, user_id, event_id, event_type from events
 order by {CAP.format(seed=4, keys='cast(event_id as varchar)')}, event_id limit 500""",
    "referential_subset": f"""with lines as (select * from lineitem
  order by {CAP.format(seed=6, keys="l_orderkey, '|', l_linenumber, '|', l_partkey, '|', l_suppkey")}, l_orderkey, l_linenumber, l_partkey, l_suppkey limit 1000),
 o as (select * from orders where o_orderkey in (select l_orderkey from lines)),
 s as (select * from supplier where s_suppkey in (select l_suppkey from lines)),
 p as (select * from part where p_partkey in (select l_partkey from lines)),
 c as (select * from customer where c_custkey in (select o_custkey from o)),
 n as (select * from nation where n_nationkey in (select c_nationkey from c union select s_nationkey from s)),
 r as (select * from region where r_regionkey in (select n_regionkey from n)),
 u as (select 'lineitem' as table_name, cast(l_orderkey as bigint) as key from lines union all select 'orders', o_orderkey from o union all select 'supplier', s_suppkey from s
  union all select 'part', p_partkey from p union all select 'customer', c_custkey from c union all select 'nation', n_nationkey from n union all select 'region', r_regionkey from r)
 select table_name, key, count(*) as num_rows from u group by 1, 2""",
}
