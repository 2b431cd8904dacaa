"""Knowledge-graph retrieval and graph analytics as Spark plans."""
