"""Invoice reconciliation and table cleaning as Spark jobs."""
