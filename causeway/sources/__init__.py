"""Tables in and out: scans, market views over the given tables, and the store of runs."""
