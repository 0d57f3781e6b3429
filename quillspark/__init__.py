"""Part of quillspark, paragraph analytics on Spark DataFrames."""
