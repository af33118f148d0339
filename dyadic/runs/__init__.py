"""Runs of one configuration: validation, execution, artifacts, checks and gates."""
