"""Registered queries: operators applied to the driver tables, each with comparison SQL."""
