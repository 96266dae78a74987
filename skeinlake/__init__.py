"""skeinlake: search and session analytics over activity logs, as plain Spark plans."""
