"""corpuscle: DataFrame operators for annotated text corpora and lexica on Spark."""
