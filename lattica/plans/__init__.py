"""SPARQL: parser, planner and query recovery."""
