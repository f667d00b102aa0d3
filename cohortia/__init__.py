"""cohortia: customer, marketing, survey and score analysis on Spark DataFrames."""
