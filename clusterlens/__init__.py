"""Cost, configuration and utilization reports over a fleet of compute clusters."""

from clusterlens.config import AnalysisConfig
from clusterlens.sources.tables import InputTables

__all__ = ["AnalysisConfig", "InputTables"]
