"""Decision rules, the end-to-end run, scoring and the report."""
