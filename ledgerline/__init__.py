"""Spend and revenue forecasting over Spark DataFrames."""

KEY = ["doc_id", "fund_year", "item"]
