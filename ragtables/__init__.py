"""Spark jobs for document retrieval, answer checking and evaluation over tables."""
