"""Enrolment analytics and forecasting over a star schema, written for Spark."""
