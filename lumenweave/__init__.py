"""Still-image codec analytics on Spark: blocks, coefficients, pixels and rate-distortion points as DataFrames."""
