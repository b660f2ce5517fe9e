"""listwarden: watch-list screening and the analytics around it, as Spark jobs."""
