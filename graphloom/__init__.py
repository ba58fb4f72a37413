"""Knowledge-graph, retrieval and text-structure analytics on Spark DataFrames."""
