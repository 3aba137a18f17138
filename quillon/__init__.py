"""Retrieval, answering and evaluation over corpora, as Spark DataFrames."""
