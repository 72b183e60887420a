"""Results that keep arriving: run logs followed into a result table."""
