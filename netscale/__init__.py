"""netscale: multivariate time series as networks across scales, on PySpark."""
