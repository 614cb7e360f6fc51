"""quillspark: analytics over assessment data as PySpark DataFrame operators."""
