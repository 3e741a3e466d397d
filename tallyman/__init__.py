"""Retail order data on Spark: intake, order tables, inventory, change feeds, an event lake and migration."""
