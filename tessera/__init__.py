"""tessera: a Spark-native engine for searching, walking and reporting over a corpus of text and source files."""
