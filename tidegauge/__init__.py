"""Demand forecasting, capacity risk and corpus preparation as Spark DataFrame jobs."""
