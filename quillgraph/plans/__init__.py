"""Registered queries: plans over the driver's tables with their SQL."""
