"""All registered queries by name."""

from mirrorframe.plans import benchmark_queries, metric_queries, result_queries, synth_queries

QUERIES = {
    **result_queries.QUERIES, **synth_queries.QUERIES, **metric_queries.QUERIES, **benchmark_queries.QUERIES,
}
