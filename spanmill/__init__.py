"""spanmill: analytics over GenAI trace spans, written as plain PySpark.

``sources`` reads and writes the tables, ``functions`` holds column expressions,
``operators`` maps DataFrames to DataFrames, ``streaming`` holds the Structured
Streaming pipelines and ``plans`` the composed jobs and the query catalogue.
"""
