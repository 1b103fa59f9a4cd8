"""Store, tree, retrieval and job operators: DataFrame in, DataFrame out."""
