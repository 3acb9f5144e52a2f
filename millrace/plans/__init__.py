"""Query front ends (operator IR, Cypher subset, pipelines) and the query catalogue."""
