"""Requirement-coverage analytics on Spark."""
