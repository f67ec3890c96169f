"""Event analytics operators: DataFrame in, lazy DataFrame out."""
