"""The report catalog (key -> Spark job) and its independent SQL oracle."""
