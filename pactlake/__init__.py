"""Contract-portfolio analytics on Spark."""
