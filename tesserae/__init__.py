"""Analytics over text corpora, question-and-answer sets and vector collections, on Spark."""
