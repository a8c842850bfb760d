"""seqspark: behaviour analytics over grouped event sequences, built on Spark DataFrames."""
