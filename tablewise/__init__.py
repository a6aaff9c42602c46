"""tablewise — business-table analytics on Spark DataFrames.

Ingest files, clean and de-duplicate rows, parse locale numbers and dates,
profile columns, infer types and roles, score quality, build a star schema and
answer dashboard and usage queries.  Every operator is a DataFrame plan.
"""

__version__ = "0.1.0"
