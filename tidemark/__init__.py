"""Month-end forecasting of daily panels, written as Spark DataFrame jobs."""
