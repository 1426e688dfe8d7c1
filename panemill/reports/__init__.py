"""Accuracy, latency, traffic and resource reports."""
