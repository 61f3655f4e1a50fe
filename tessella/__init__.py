"""tessella: curation of paired text corpora and analysis of model evaluations, on PySpark."""
