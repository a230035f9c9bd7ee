"""SQL equivalents of the result queries."""

RESULTS_V = """results_v as (
 select concat('d', cast(l_partkey % 12 as varchar)) as Dataset,
  case l_suppkey % 6 when 0 then 'UniformSynthesizer' when 1 then 'GaussianCopulaSynthesizer'
   when 2 then 'ColumnSynthesizer(1)' when 3 then 'CTGANSynthesizer(1)'
   when 4 then 'TVAESynthesizer(2)' else 'CopulaGANSynthesizer' end as Synthesizer,
  cast(count(*) % 97 + 1 as double) as Train_Time,
  cast(count(*) % 13 as double) as Sample_Time,
  cast(sum(l_linenumber) % 101 as double) / 101 as Quality_Score,
  cast(sum(l_linenumber) % 7 as double) / 7 as Diagnostic_Score,
  case when max(l_orderkey) % 11 = 0 then 'Synthesizer Timeout'
       when max(l_orderkey) % 7 = 0 then 'ValueError: bad fit' end as Error
 from lineitem group by 1, 2)"""

FILES_V = """files_v as (
 select concat('results_0', cast(l_linenumber % 3 + 1 as varchar), '_01_2026') as run,
  cast(l_orderkey % 2 as int) as file_no,
  concat('d', cast(l_partkey % 12 as varchar)) as Dataset,
  case l_suppkey % 6 when 0 then 'UniformSynthesizer' when 1 then 'GaussianCopulaSynthesizer'
   when 2 then 'ColumnSynthesizer' when 3 then 'CTGANSynthesizer'
   when 4 then 'TVAESynthesizer' else 'CopulaGANSynthesizer' end as Synthesizer,
  cast(count(*) % 97 + 1 as double) as Train_Time,
  cast(count(*) % 13 as double) as Sample_Time,
  cast(sum(l_linenumber) % 101 as double) / 101 as Quality_Score,
  case when max(l_orderkey) % 11 = 0 then 'Synthesizer Timeout'
       when max(l_orderkey) % 7 = 0 then 'ValueError: bad fit' end as Error,
  cast(min(l_suppkey % 6) as bigint) as row_no
 from lineitem where l_partkey % 12 + l_suppkey % 6 <> 14 group by 1, 2, 3, 4)"""

PLAIN = """plain as (
 select Dataset, trim(regexp_replace(Synthesizer, '\\s*\\(\\d+\\)\\s*$', '')) as Synthesizer,
  Train_Time, Sample_Time, Quality_Score, Diagnostic_Score, Error from results_v)"""


def _best(source, by="", order="Synthesizer"):
    return f"""best as (
 select * from {source}
 qualify row_number() over (partition by {by}Dataset, Synthesizer
  order by (contains(Synthesizer, 'UniformSynthesizer') and Error is not null), {order}) = 1)"""


def _scored(source, by="", order="Synthesizer", timeout="345600.0"):
    on = " and ".join(f"r.{c} = b.{c}" for c in [*[x.strip() for x in by.split(",") if x.strip()], "Dataset"])
    return f"""base as (
 select {by}Dataset, Train_Time as bf, Sample_Time as bs, Quality_Score as bq from {source}
 where contains(Synthesizer, 'UniformSynthesizer')
 qualify row_number() over (partition by {by}Dataset order by {order}) = 1),
scored as (
 select r.*,
  case when bf is null or bs is null then null
       when Error = 'Synthesizer Timeout' then bf + {timeout} + bs
       when Error is not null then bf + coalesce(Train_Time, 0) + coalesce(Sample_Time, 0) + bs
       else bf + coalesce(Train_Time, 0) + coalesce(Sample_Time, 0) end as Adjusted_Total_Time,
  case when bf is null or bs is null or bq is null then null
       when Error is not null then bq else Quality_Score end as Adjusted_Quality_Score
 from {source} r left join base b on {on})"""


FALLBACK = """filled as (
 select s.* replace (
  case when (select count(Adjusted_Quality_Score) from scored) = 0 then Quality_Score
       else Adjusted_Quality_Score end as Adjusted_Quality_Score,
  case when (select count(Adjusted_Total_Time) from scored) = 0 then Train_Time + Sample_Time
       else Adjusted_Total_Time end as Adjusted_Total_Time) from scored s),
complete as (
 select * from filled where Dataset in (
  select Dataset from filled group by 1
  having count(distinct Synthesizer) = (select count(distinct Synthesizer) from filled)))"""

FALLBACK_RUNS = """filled as (
 select s.* replace (
  case when count(Adjusted_Quality_Score) over (partition by run) = 0 then Quality_Score
       else Adjusted_Quality_Score end as Adjusted_Quality_Score,
  case when count(Adjusted_Total_Time) over (partition by run) = 0 then Train_Time + Sample_Time
       else Adjusted_Total_Time end as Adjusted_Total_Time) from scored s),
complete as (
 select * from filled f where (run, Dataset) in (
  select (run, Dataset) from filled group by run, Dataset
  having count(distinct Synthesizer) = (select count(distinct Synthesizer) from filled g where g.run = filled.run)))"""


def _judged(source, by="", order="Synthesizer"):
    keys = [*[x.strip() for x in by.split(",") if x.strip()], "Dataset"]
    on = " and ".join(f"c.{k} = g.{k}" for k in keys)
    same = " and ".join(f"o.{k} = c.{k}" for k in keys)
    return f"""gauss as (
 select {by}Dataset, Adjusted_Quality_Score as gq from {source} where Synthesizer = 'GaussianCopulaSynthesizer'
 qualify row_number() over (partition by {by}Dataset order by {order}) = 1),
judged as (
 select c.*,
  coalesce(c.Adjusted_Quality_Score >= gq, false) as Meets_Baseline_Quality,
  not exists (select 1 from {source} o where {same} and o.Adjusted_Quality_Score > c.Adjusted_Quality_Score
   and o.Adjusted_Total_Time < c.Adjusted_Total_Time) as On_Pareto_Frontier
 from {source} c left join gauss g on {on})"""


PLAIN_SCORED = f"with {RESULTS_V}, {PLAIN}, {_scored('plain')}"
PROCESSED = f"with {RESULTS_V}, {PLAIN}, {_best('plain')}, {_scored('best')}, {FALLBACK}, {_judged('complete')}"
ONE_RUN = f"""with {FILES_V}, one_run as (select * from files_v where run = 'results_03_01_2026'),
{_best('one_run', order='file_no, row_no')}, {_scored('best', order='file_no, row_no')}, {FALLBACK}"""
VERSIONS = """versions as (
 select concat('results_0', cast(l_linenumber % 3 + 1 as varchar), '_01_2026') as run,
  concat('0.13.', cast(max(l_orderkey) % 5 as varchar)) as version,
  case when max(l_orderkey) % 2 = 0 then max(l_shipdate) end as completed_date,
  min(l_shipdate) as starting_date
 from lineitem where l_linenumber % 3 <> 1 group by 1)"""
ALL_RUNS = f"""with {FILES_V}, {_best('files_v', 'run, ', 'file_no, row_no')},
{_scored('best', 'run, ', 'file_no, row_no')}, {FALLBACK_RUNS}, {_judged('complete', 'run, ', 'file_no, row_no')}, {VERSIONS}"""

MODELS = """models as (
 select Synthesizer, coalesce(sum(Adjusted_Total_Time), 0.0) as Aggregated_Time,
  avg(Adjusted_Quality_Score) as Quality_Score from scored group by 1),
logged as (
 select *, case when Aggregated_Time > 0 then log10(Aggregated_Time) else 0.0 end as Log10_Aggregated_Time,
  coalesce(Quality_Score = max(Quality_Score) over (order by Aggregated_Time, Quality_Score desc nulls last, Synthesizer
   rows between unbounded preceding and current row), false) as Pareto,
  row_number() over (order by Aggregated_Time, Quality_Score desc nulls last, Synthesizer) - 1 as pos
 from models)"""
MARKERS = """['circle', 'square', 'diamond', 'cross', 'x', 'triangle-up', 'triangle-down', 'triangle-left',
 'triangle-right', 'pentagon', 'hexagon', 'hexagon2', 'octagon', 'star', 'hexagram', 'star-triangle-up',
 'star-triangle-down', 'star-square', 'star-diamond', 'diamond-tall', 'diamond-wide', 'hourglass', 'bowtie',
 'circle-cross', 'circle-x', 'square-cross', 'square-x', 'diamond-cross', 'diamond-x']"""
ENDS = """frontier as (
 select Log10_Aggregated_Time as x, max(Quality_Score) as y, row_number() over (order by Log10_Aggregated_Time) as i,
  row_number() over (order by Log10_Aggregated_Time desc) as j from logged where Pareto group by 1),
ends as (
 select log10((select min(Aggregated_Time) from logged)) - 0.25 as x,
  (select x from frontier where i = 1) as ax, (select y from frontier where i = 1) as ay,
  (select x from frontier where i = 2) as bx, (select y from frontier where i = 2) as by_
 union all
 select log10((select max(Aggregated_Time) from logged)) + 0.25,
  (select x from frontier where j = 2), (select y from frontier where j = 2),
  (select x from frontier where j = 1), (select y from frontier where j = 1)),
end_points as (
 select pow(10.0, x) as Aggregated_Time, ay + (x - ax) * (by_ - ay) / (bx - ax) as Quality_Score,
  x as Log10_Aggregated_Time, true as Pareto from ends where (select count(*) from frontier) >= 2)"""

GAPS = """gaps as (
 select Dataset, Synthesizer, avg(case when Error is null then Quality_Score end) as Quality_Score,
  avg(Train_Time) as Train_Time, min(Error) as Error from files_v group by 1, 2)"""
PAIRS = """pairs as (
 select Dataset, Synthesizer, avg(Quality_Score) as Quality_Score, avg(Train_Time) as Train_Time, min(Error) as Error
 from plain group by 1, 2)"""
JOBS = """jobs_v as (
 select concat('d', cast(l_partkey % 12 as varchar)) as Dataset,
  case l_suppkey % 6 when 0 then 'UniformSynthesizer' when 1 then 'GaussianCopulaSynthesizer'
   when 2 then 'ColumnSynthesizer(1)' when 3 then 'CTGANSynthesizer(1)'
   when 4 then 'TVAESynthesizer(2)' else 'CopulaGANSynthesizer' end as Synthesizer,
  concat('i', cast(min(l_orderkey) % 4 as varchar)) as Instance_Name,
  concat('out', cast(min(l_orderkey) % 2 as varchar)) as Output_Destination,
  min(l_orderkey) * 100 + min(l_partkey % 12) * 6 + min(l_suppkey % 6) as position
 from lineitem group by 1, 2)"""

CATALOG = """catalog_v as (
 select concat('d', cast(l_partkey % 12 as varchar)) as dataset,
  concat('t', cast(l_suppkey % 5 as varchar)) as table_name,
  concat('c', cast(l_orderkey % 9 as varchar)) as column_name,
  ['numerical', 'categorical', 'boolean', 'datetime', 'id', 'email'][cast(sum(l_linenumber) % 6 as int) + 1] as sdtype,
  min(l_orderkey % 9) = 0 as is_primary_key
 from lineitem group by 1, 2, 3)"""
EDGES = """edges_v as (
 select concat('d', cast(l_partkey % 12 as varchar)) as dataset,
  concat('t', cast(l_suppkey % 5 as varchar)) as parent_table,
  concat('t', cast(l_linenumber % 5 as varchar)) as child_table,
  concat('k', cast(l_partkey % 24 as varchar)) as child_key
 from lineitem where l_suppkey % 5 < l_linenumber % 5 and (l_partkey + l_suppkey + l_linenumber) % 3 = 0
  and l_partkey % 12 <> 7 group by 1, 2, 3, 4)"""
DEPTH = """chain(dataset, table_name, depth) as (
 select distinct dataset, parent_table, 1 from edges_v
 union select c.dataset, e.child_table, c.depth + 1 from chain c
  join edges_v e on e.dataset = c.dataset and e.parent_table = c.table_name)"""
COLUMN_COUNTS = """per_table as (
 select dataset, table_name, count(*) as n,
  count(*) filter (sdtype in ('categorical', 'boolean')) as cat, count(*) filter (sdtype = 'numerical') as num,
  count(*) filter (sdtype = 'datetime') as dt, count(*) filter (sdtype = 'id' and not is_primary_key) as idn,
  count(*) filter (sdtype = 'email' and not is_primary_key) as pii
 from catalog_v group by 1, 2)"""
PROFILE = f"""with recursive {CATALOG}, {EDGES}, {DEPTH}, {COLUMN_COUNTS},
sizes as (select concat('d', cast(l_partkey % 12 as varchar)) as dataset,
  concat('t', cast(l_suppkey % 5 as varchar)) as table_name, count(*) as n from lineitem group by 1, 2),
totals as (select dataset, cast(sum(n) as bigint) as rows_, max(n) as most from sizes group by 1),
parents as (select dataset, parent_table, count(*) as n from edges_v group by 1, 2),
branches as (select dataset, cast(sum(n) as bigint) as edges, max(n) as branch from parents group by 1),
depths as (select dataset, max(depth) as depth from chain group by 1),
profile as (
 select p.dataset as Dataset, cast(null as double) as Datasize_Size_MB, count(*) as Num_Tables, cast(sum(n) as bigint) as Total_Num_Columns,
  cast(sum(cat) as bigint) as Total_Num_Columns_Categorical, cast(sum(num) as bigint) as Total_Num_Columns_Numerical,
  cast(sum(dt) as bigint) as Total_Num_Columns_Datetime, cast(sum(pii) as bigint) as Total_Num_Columns_PII,
  cast(sum(idn) as bigint) as Total_Num_Columns_ID_NonKey, max(n) as Max_Num_Columns_Per_Table,
  any_value(rows_) as Total_Num_Rows, any_value(most) as Max_Num_Rows_Per_Table,
  coalesce(any_value(edges), 0) as Num_Relationships,
  cast(coalesce(any_value(depth), 1) as bigint) as Max_Schema_Depth, coalesce(any_value(branch), 0) as Max_Schema_Branch
 from per_table p left join totals t on t.dataset = p.dataset left join branches b on b.dataset = p.dataset
  left join depths d on d.dataset = p.dataset group by 1)"""

RUN_DATE = "strptime(run[9:], '%m_%d_%Y')"

SQL = {
    "wins_per_synthesizer": f"{PROCESSED} select Synthesizer, cast(sum(cast(Meets_Baseline_Quality and On_Pareto_Frontier as int)) as bigint) as Wins from judged group by 1",
    "adjusted_scores": f"{PLAIN_SCORED} select Dataset, Synthesizer, round(Adjusted_Total_Time, 6) as Adjusted_Total_Time, round(Adjusted_Quality_Score, 6) as Adjusted_Quality_Score from scored",
    "uniform_times": f"{PLAIN_SCORED} select r.Dataset, Synthesizer, Train_Time, bf as Uniform_Train_Time, bs as Uniform_Sample_Time from plain r left join base b on r.Dataset = b.Dataset",
    "process_results": f"{ONE_RUN} select Dataset, Synthesizer, Train_Time, Sample_Time, Error, file_no, row_no, round(Adjusted_Total_Time, 6) as Adjusted_Total_Time, round(Adjusted_Quality_Score, 6) as Adjusted_Quality_Score from complete",
    "pareto_per_dataset": f"{PLAIN_SCORED}, {_judged('scored')} select Dataset, Synthesizer, On_Pareto_Frontier from judged",
    "meets_baseline": f"{PLAIN_SCORED}, {_judged('scored')} select Dataset, Synthesizer, Meets_Baseline_Quality from judged",
    "summary_pivot": f"""{ALL_RUNS},
counts as (select run, case when count(distinct Dataset) filter (Synthesizer = 'GaussianCopulaSynthesizer') > 0
  then count(distinct Dataset) filter (Synthesizer = 'GaussianCopulaSynthesizer') else count(distinct Dataset) end as n
  from judged group by 1),
headers as (select c.run, {RUN_DATE.replace('run', 'c.run')} as day, concat(c.run[9:], ' - # datasets: ', cast(n as varchar), ' - version: ', coalesce(version, 'None')) as header
  from counts c left join versions v on v.run = c.run),
won as (select run, Synthesizer, sum(cast(Meets_Baseline_Quality and On_Pareto_Frontier as int)) as w from judged group by 1, 2),
newest as (select distinct Synthesizer from judged where run = (select run from headers order by day desc limit 1))
select n.Synthesizer, h.header, coalesce(cast(cast(w as bigint) as varchar), '-') as wins
from newest n cross join headers h left join won on won.run = h.run and won.Synthesizer = n.Synthesizer""",
    "datasets_in_run": f"with {FILES_V} select run, case when count(distinct Dataset) filter (Synthesizer = 'GaussianCopulaSynthesizer') > 0 then count(distinct Dataset) filter (Synthesizer = 'GaussianCopulaSynthesizer') else count(distinct Dataset) end as Num_Datasets from files_v group by 1",
    "runs_not_later": f"with {FILES_V} select run, count(*) as num_rows from files_v where {RUN_DATE} <= timestamp '2026-02-01' group by 1",
    "latest_run": f"with {FILES_V} select run as latest_folder from files_v order by {RUN_DATE} desc limit 1",
    "runs_complete": f"with {VERSIONS} select count(*) > 0 and coalesce(bool_and(completed_date is not null), false) as all_complete from versions",
    "aggregated_time": f"{PLAIN_SCORED}, {MODELS} select Synthesizer, round(Aggregated_Time, 6) as Aggregated_Time, round(Quality_Score, 6) as Quality_Score, round(Log10_Aggregated_Time, 6) as Log10_Aggregated_Time from logged",
    "pareto_models": f"{PLAIN_SCORED}, {MODELS} select Synthesizer, Pareto from logged",
    "pareto_end_points": f"with {RESULTS_V}, {PLAIN}, {_scored('plain', timeout='20.0')}, {MODELS}, {ENDS} select round(Aggregated_Time, 3) as Aggregated_Time, round(Quality_Score, 6) as Quality_Score, round(Log10_Aggregated_Time, 6) as Log10_Aggregated_Time, Pareto from end_points",
    "markers": f"{PLAIN_SCORED}, {MODELS} select Synthesizer, {MARKERS}[pos % 29 + 1] as Marker from logged",
    "plot_data": f"""{PLAIN_SCORED}, {MODELS}, {ENDS}
select replace(Synthesizer, 'Synthesizer', '') as Synthesizer, round(Aggregated_Time, 3) as Aggregated_Time, round(Quality_Score, 6) as Quality_Score,
 round(Log10_Aggregated_Time, 6) as Log10_Aggregated_Time, Pareto, case when Pareto then '#01E0C9' else '#03AFF1' end as Color, {MARKERS}[pos % 29 + 1] as Marker from logged
union all select null, round(Aggregated_Time, 3), round(Quality_Score, 6), round(Log10_Aggregated_Time, 6), Pareto, '#01E0C9', null from end_points""",
    "load_results_filtered": f"with {RESULTS_V}, {PLAIN} select Dataset, Synthesizer, Train_Time, Sample_Time, round(Quality_Score, 6) as Quality_Score, round(Diagnostic_Score, 6) as Diagnostic_Score, Error from plain where Dataset in ('d1', 'd2', 'd5') and Synthesizer in ('CTGANSynthesizer', 'UniformSynthesizer')",
    "summary_projection": f"{PLAIN_SCORED} select Dataset, Synthesizer, round(Adjusted_Total_Time, 6) as Adjusted_Total_Time, round(Adjusted_Quality_Score, 6) as Adjusted_Quality_Score, round(Diagnostic_Score, 6) as Diagnostic_Score from scored",
    "complete_datasets": f"""with {FILES_V} select run, file_no, Dataset, case Synthesizer when 'ColumnSynthesizer' then 'ColumnSynthesizer(1)' when 'CTGANSynthesizer' then 'CTGANSynthesizer(1)' when 'TVAESynthesizer' then 'TVAESynthesizer(2)' else Synthesizer end as Synthesizer from files_v where (run, Dataset) in (
 select (run, Dataset) from files_v f group by run, Dataset having count(distinct Synthesizer) = (select count(distinct Synthesizer) from files_v g where g.run = f.run))""",
    "dedup_best": f"with {FILES_V}, {_best('files_v', 'run, ', 'file_no, row_no')} select run, Dataset, Synthesizer, file_no, Train_Time, Error from best",
    "coverage": f"""with {FILES_V}, {GAPS} select Synthesizer, count(Quality_Score) as solved, (select count(distinct Dataset) from gaps) as total,
 round(cast(count(Quality_Score) as double) / (select count(distinct Dataset) from gaps), 6) as coverage_perc,
 concat(cast(count(Quality_Score) as varchar), ' / ', cast((select count(distinct Dataset) from gaps) as varchar)) as coverage from gaps group by 1""",
    "mean_score": f"with {FILES_V}, {GAPS} select Synthesizer, round(avg(Quality_Score), 6) as avg_score from gaps group by 1",
    "mean_seconds": f"with {RESULTS_V}, {PLAIN}, {PAIRS} select Synthesizer, round_even(avg(Train_Time), 0) as time from pairs group by 1",
    "best_rank_counts": f"""with {RESULTS_V}, {PLAIN}, {PAIRS}, ranked as (select Synthesizer, dense_rank() over (partition by Dataset order by Train_Time) as r from pairs where Train_Time is not null)
 select Synthesizer, count(*) filter (r = 1) as first, count(*) filter (r = 2) as second, count(*) filter (r = 3) as third from ranked group by 1""",
    "beat_baseline": f"""with {FILES_V}, {GAPS}, base as (select Dataset, Quality_Score as q from gaps where Synthesizer = 'GaussianCopulaSynthesizer'),
 names as (select distinct Synthesizer from gaps where Synthesizer <> 'GaussianCopulaSynthesizer')
 select n.Synthesizer, count(*) filter (coalesce(g.Quality_Score, '-infinity'::double) >= coalesce(b.q, '-infinity'::double)) as beaten
 from names n cross join base b left join gaps g on g.Synthesizer = n.Synthesizer and g.Dataset = b.Dataset group by 1""",
    "legacy_summary": f"""with {FILES_V}, {GAPS}, rest as (select * from gaps where Synthesizer <> 'UniformSynthesizer'),
 total as (select count(distinct Dataset) as total from rest),
 base as (select Dataset, Quality_Score as q from gaps where Synthesizer = 'UniformSynthesizer'),
 names as (select distinct Synthesizer from rest),
 beaten as (select n.Synthesizer, count(*) filter (coalesce(g.Quality_Score, '-infinity'::double) >= coalesce(b.q, '-infinity'::double)) as beaten
  from names n cross join base b left join rest g on g.Synthesizer = n.Synthesizer and g.Dataset = b.Dataset group by 1),
 tr as (select Synthesizer, dense_rank() over (partition by Dataset order by Train_Time) as r from rest where Train_Time is not null),
 times as (select Synthesizer, count(*) filter (r = 1) as a, count(*) filter (r = 2) as b, count(*) filter (r = 3) as c from tr group by 1),
 qr as (select Synthesizer, dense_rank() over (partition by Dataset order by Quality_Score desc) as r from rest where Quality_Score is not null),
 quality as (select Synthesizer, count(*) filter (r = 1) as a from qr group by 1),
 own as (select Synthesizer, count(Quality_Score) as solved, round_even(avg(Train_Time), 0) as time, round(avg(Quality_Score), 6) as avg_score,
  count(*) filter (contains(Error, 'Synthesizer Timeout')) as timeout, count(*) filter (contains(Error, 'MemoryError')) as memory_error,
  count(*) filter (Error is not null and not contains(Error, 'Synthesizer Timeout') and not contains(Error, 'MemoryError')) as errors
  from rest group by 1)
 select o.Synthesizer, solved, total, round(cast(solved as double) / total, 6) as coverage_perc,
  concat(cast(solved as varchar), ' / ', cast(total as varchar)) as coverage, time, avg_score, coalesce(q.a, 0) as best,
  coalesce(t.a, 0) as best_time, coalesce(t.b, 0) as second_best_time, coalesce(t.c, 0) as third_best_time, beaten as beat_uniformsynthesizer,
  timeout, memory_error, errors, total - solved - errors as metric_errors
 from own o cross join total left join quality q on q.Synthesizer = o.Synthesizer left join times t on t.Synthesizer = o.Synthesizer
  left join beaten on beaten.Synthesizer = o.Synthesizer""",
    "errors_pivot": f"""with {FILES_V}, texts as (select Synthesizer, concat(Error, ' #', cast(row_no % 2 as varchar)) as Error from files_v where Error is not null and not contains(Error, 'Synthesizer Timeout'))
 select Error, count(*) as "all", count(*) filter (Synthesizer = 'CTGANSynthesizer') as "CTGANSynthesizer",
  count(*) filter (Synthesizer = 'ColumnSynthesizer') as "ColumnSynthesizer", count(*) filter (Synthesizer = 'CopulaGANSynthesizer') as "CopulaGANSynthesizer",
  count(*) filter (Synthesizer = 'GaussianCopulaSynthesizer') as "GaussianCopulaSynthesizer", count(*) filter (Synthesizer = 'TVAESynthesizer') as "TVAESynthesizer",
  count(*) filter (Synthesizer = 'UniformSynthesizer') as "UniformSynthesizer" from texts group by 1""",
    "error_counts": f"with {RESULTS_V}, {PLAIN} select Synthesizer, count(distinct Dataset) filter (Error = 'Synthesizer Timeout') as Timeouts, count(distinct Dataset) filter (Error <> 'Synthesizer Timeout') as Errors from plain group by 1",
    "library_class": f"""with {RESULTS_V}, {PLAIN} select case when regexp_matches(lower(Synthesizer), 'ctgan|copulagan|gaussiancopula|tvae|hma1|par') then 'In-house'
  when regexp_matches(lower(Synthesizer), 'dragan|vanillagan|wgan') then 'YData' else 'Other' end as library,
  count(distinct Synthesizer) as models, count(*) as num_rows from plain group by 1""",
    "leaderboard": f"with {RESULTS_V}, {PLAIN} select Synthesizer, round(avg(Train_Time), 6) as Train_Time, round(avg(Quality_Score), 6) as Quality_Score from plain group by 1 order by 3 desc",
    "short_errors": f"""with {RESULTS_V}, texts as (select *, concat(Error, ' in ', Dataset, ' of ', Synthesizer) as t from results_v where Error is not null)
 select Dataset, Synthesizer, case when length(t) > 30 then concat(t[1:30], '...') else t end as short_error,
  replace(trim(regexp_replace(Synthesizer, '\\s*\\(\\d+\\)\\s*$', '')), 'Synthesizer', '') as short_name,
  contains(Error, 'Synthesizer Timeout') as timeout,
  case when not contains(Error, 'Synthesizer Timeout') and not contains(Error, 'MemoryError') then Error end as unknown_error from texts""",
    "best_model": f"{PLAIN_SCORED} select Dataset, Synthesizer as Best_Model from scored where Adjusted_Quality_Score is not null qualify row_number() over (partition by Dataset order by Adjusted_Quality_Score desc, Synthesizer desc) = 1",
    "model_details": f"""{PROCESSED}, models as (
 select Synthesizer, coalesce(sum(Adjusted_Total_Time), 0.0) as t, avg(Adjusted_Quality_Score) as q from judged group by 1),
 curve as (select *, coalesce(q = max(q) over (order by t, q desc nulls last, Synthesizer rows between unbounded preceding and current row), false) as pareto from models),
 described as (select trim(regexp_replace(Synthesizer, '\\s*\\(\\d+\\)\\s*$', '')) as Synthesizer, concat('lib', cast(count(*) as varchar)) as library, case when max(Train_Time) > 50 then 'Slow' end as type from results_v where Synthesizer < 'D' group by 1),
 won as (select Synthesizer, sum(cast(Meets_Baseline_Quality and On_Pareto_Frontier as int)) as w,
  count(distinct Dataset) filter (Error = 'Synthesizer Timeout') as t, count(distinct Dataset) filter (Error <> 'Synthesizer Timeout') as e from judged group by 1)
 select w.Synthesizer, replace(w.Synthesizer, 'Synthesizer', '') as "Model Name", case when d.Synthesizer is null then 'Unknown' else 'single_table' end as "Data Modality",
  coalesce(library, 'In-house') as "Source", 'Unknown' as "Organization", coalesce(type, 'Unknown') as "Type", 'No description available.' as "Description",
  cast(w as bigint) as "Number of datasets - Wins", w.t as "Number of datasets - Timeout", w.e as "Number of datasets - Errors", pareto as "On the Pareto Curve"
 from won w left join described d on d.Synthesizer = w.Synthesizer left join curve c on c.Synthesizer = w.Synthesizer""",
    "dataset_details": f"""{PROFILE}, {RESULTS_V}, {PLAIN}, {_scored('plain')},
 best as (select Dataset, Synthesizer from scored where Adjusted_Quality_Score is not null qualify row_number() over (partition by Dataset order by Adjusted_Quality_Score desc, Synthesizer desc) = 1),
 numbered as (select *, cast(Dataset[2:] as int) as i from profile)
 select n.Dataset, case when i % 2 = 0 then 'Public' else 'Private' end as Availability, b.Synthesizer as Best_Model, Total_Num_Columns, Total_Num_Rows, 'single_table' as Data_Modality
 from numbered n left join best b on b.Dataset = n.Dataset where (i % 2 = 0 or i % 3 = 0) and n.Dataset <> 'd11'""",
    "upsert_by_key": f"""with {RESULTS_V} select Dataset, Synthesizer, Train_Time from results_v where Dataset not in ('d2', 'd3')
 union all select Dataset, Synthesizer, Train_Time + 100 from results_v where Dataset in ('d2', 'd3')""",
    "missing_job_rows": f"""with {RESULTS_V} select Dataset, Synthesizer, Train_Time, Error from results_v where Train_Time > 30
 union all select Dataset, Synthesizer, null, 'Instance Deadline Error' from results_v where Train_Time <= 30""",
    "job_status": f"""with {JOBS}, seen as (select *, case position % 3 when 0 then 'Completed' when 1 then 'Failed' else 'Queued' end as s, Instance_Name in ('i0', 'i1') as running from jobs_v),
 firsts as (select Instance_Name, min(position) as f from seen where s = 'Queued' and running group by 1)
 select Dataset, Synthesizer, s.Instance_Name, Output_Destination, case when s <> 'Queued' then s when not running then 'Failed' when position = f then 'Running' else 'Queued' end as Status
 from seen s left join firsts f on f.Instance_Name = s.Instance_Name""",
    "job_grid": f"with {RESULTS_V} select Dataset, Synthesizer from (select distinct Dataset from results_v) cross join (values ('UniformSynthesizer'), ('ColumnSynthesizer'), ('Variant:Wide')) t(Synthesizer)",
    "collect_distinct": f"""with {RESULTS_V} select Dataset, Synthesizer, Train_Time, Error, null::double as Sample_Time from results_v
 union select Dataset, Synthesizer, Train_Time, null, Sample_Time from results_v""",
    "bucket_precedence": """with listings as (select p_type as dataset_name, p_brand as root, cast(sum(p_size) as bigint) as size, min(p_size) as priority from part group by 1, 2)
 select dataset_name, root, size, priority from listings qualify row_number() over (partition by dataset_name order by priority, root) = 1""",
    "missing_names": "select distinct o_custkey as Dataset from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)",
    "dataset_selection": f"with {RESULTS_V} select Dataset, count(*) as num_rows from results_v where Dataset in ('d1', 'd3', 'd4') group by 1",
    "deadline_passed": "select o_orderkey, n >= o_orderdate + interval 1 day + to_seconds(round(o_totalprice, 0)) as passed from orders join (select l_orderkey, max(l_shipdate) as n from lineitem group by 1) on l_orderkey = o_orderkey",
    "run_index_latest": f"""with {VERSIONS}, {FILES_V}, runs as (select strftime(starting_date, '%Y-%m-%d') as date, run from versions
 union all select concat('2026-01-', lpad(cast(max(row_no) + count(*) % 20 + 1 as varchar), 2, '0')), run from files_v group by run)
 select run as folder_name, date as latest_date from runs order by date desc, run desc limit 1""",
    "run_names": """select strftime(o_orderdate, 'results_%m_%d_%Y') as folder, concat(strftime(o_orderdate, 'run_%m_%d_%Y_'), cast(count(*) as varchar)) as run_id,
 strftime(o_orderdate, '%Y-%m-%d') as parsed from orders group by cast(o_orderdate as date), o_orderdate""",
    "evaluate_times": f"""with {RESULTS_V} select Dataset, Synthesizer, case when nullif(Sample_Time, 0.0) is not null or Error is null or Train_Time > 50
  then coalesce(nullif(Sample_Time, 0.0), 0.0) + case when Error is null then Train_Time else 0.0 end end as Evaluate_Time from results_v""",
}
