"""docloom: document understanding over tables of many documents, written for Spark."""
