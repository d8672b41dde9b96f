"""Evidence analytics on Spark: evaluation, calibration, verdicts, retrieval, provenance and grounding over DataFrames."""
