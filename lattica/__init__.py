"""Knowledge-graph analytics and answer evaluation on Spark."""
