"""Interface-to-application topology, blast radius and path health on Spark DataFrames."""
