"""caseflow: analytics over regulatory enforcement cases, as plain Spark DataFrame functions."""
