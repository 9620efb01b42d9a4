"""vellumq: document retrieval, evaluation and text-table operators on Spark DataFrames."""
