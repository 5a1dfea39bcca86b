"""graphloom: interval, graph, vector and detection analytics as Spark DataFrame operators."""
