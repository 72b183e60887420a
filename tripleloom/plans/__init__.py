"""Measured plan choices: size checks, work profiles, hot-key splitting, method choice."""
