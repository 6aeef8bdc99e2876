"""terravec: Spark jobs for embeddings of places on Earth, DataFrame in, DataFrame out."""
