"""Sports-league analytics and corpus preparation on Spark."""
