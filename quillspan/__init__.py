"""quillspan: budgeted recall analytics as Spark DataFrames."""
