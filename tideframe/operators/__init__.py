"""DataFrame to DataFrame operators over panels of time series."""
