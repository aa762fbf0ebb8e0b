"""licmatch: licence matching, eligibility gating and ranking of job postings on Spark.

Every operator is a function from DataFrames to DataFrames (or Columns to a Column), so a
job is one declarative plan that Catalyst and AQE optimise as a whole.
"""
