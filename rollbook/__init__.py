"""Record linkage, list hygiene, survey tabulation and retrieval as Spark DataFrame operators."""
