"""Analysis operators: DataFrame in, DataFrame out."""
