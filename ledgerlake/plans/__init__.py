"""Query registry: Spark query and oracle SQL by operator id."""
