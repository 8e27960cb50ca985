"""corpusmill: text analytics over large corpora on Spark DataFrames."""
