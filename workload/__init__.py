"""The driver's tables played as a retail business: feeds, queries and their SQL."""
