"""Bike-share ride and weather analytics on Spark DataFrames, Structured Streaming and MLlib."""
