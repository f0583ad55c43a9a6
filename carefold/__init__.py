"""PySpark analytics for longitudinal health-assessment data."""

__version__ = "0.1.0"
