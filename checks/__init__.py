"""The registered queries and their SQL counterparts on the driver's tables."""
