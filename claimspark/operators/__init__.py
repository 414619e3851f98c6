"""DataFrame -> DataFrame operators: the star-join extract, dbt-style models,
app aggregates, provider set operations, cohorts, joins and limits."""
