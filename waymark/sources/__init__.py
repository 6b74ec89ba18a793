"""External services behind injectable transports, and tables that stand in for them offline."""
