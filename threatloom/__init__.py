"""Threat-report and security-alert graph analytics on Spark DataFrames."""
