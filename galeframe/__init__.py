"""Tropical-cyclone climate-risk tables on Spark: DataFrame and Column functions."""
