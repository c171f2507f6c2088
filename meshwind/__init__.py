"""meshwind: market-regime analytics and corpus preparation as Spark plans."""
