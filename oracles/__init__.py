"""The registered queries in SQL, for comparison on the same tables."""

from oracles import metrics, results, synth

SQL = {**results.SQL, **synth.SQL, **metrics.SQL}
