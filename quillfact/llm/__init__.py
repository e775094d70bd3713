"""Training-data operators: each module is one Spark job over whole tables."""
