"""quillstack: document structuring, indexing, search and evaluation as Spark DataFrames."""
