"""Stateful processing of requests, calls, receipts and journals."""
