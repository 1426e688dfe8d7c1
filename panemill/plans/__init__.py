"""What can be shared between queries: pane sizes, and the analysis of query logs."""
