"""folioflow: document-dataflow operators on PySpark DataFrames."""
