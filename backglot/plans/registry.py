"""All registered queries with their SQL twins."""

from __future__ import annotations

from backglot.plans import corpus_queries, fewshot_queries, metric_queries, pipeline_queries, report_queries, token_queries

QUERIES = {
    **corpus_queries.QUERIES,
    **token_queries.QUERIES,
    **fewshot_queries.QUERIES,
    **metric_queries.QUERIES,
    **report_queries.QUERIES,
    **pipeline_queries.QUERIES,
}
