"""Charts, statistics tables, reports and tabular schemas over query results."""
