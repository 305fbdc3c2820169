"""Panel analytics and corpus preparation on Spark."""
