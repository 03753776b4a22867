"""Message triage, corpus retrieval and support reporting as Spark plans.

Everything here takes and returns DataFrames or Columns; rules, weights and
thresholds are arguments.
"""
