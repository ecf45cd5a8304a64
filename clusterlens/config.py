"""Parameters shared by every report."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from datetime import date, timedelta
from types import MappingProxyType

ALL_WORKSPACES = "ALL"

# Accepted with the other parameters, but without effect on any report.
_INERT = frozenset({"latest_lts_version"})

# The default minimum generation of each VM series, by first letter.
DEFAULT_VM_THRESHOLDS = MappingProxyType({"D": 5, "E": 5, "F": 2, "L": 3, "M": 2, "N": 1})


@dataclass(frozen=True)
class AnalysisConfig:
    """``as_of`` stands in for the current date, so that a run can be repeated. ``exact_costs`` keeps up to 18 decimals of a
    cost where the product of two long decimal types would keep six."""

    as_of: date = field(default_factory=date.today)
    lookback_days: int = 30
    workspace_filter: str = ALL_WORKSPACES
    driver_cpu_threshold: int = 16
    driver_memory_gb_threshold: int = 64
    vm_thresholds: Mapping[str, int] = DEFAULT_VM_THRESHOLDS
    vm_threshold_default: int = 5
    cpu_threshold: int = 70
    io_wait_threshold: int = 10
    memory_threshold: int = 80
    swap_threshold: int = 1
    exact_costs: bool = False
    output_catalog: str | None = None
    output_schema: str | None = None

    def __post_init__(self) -> None:
        if self.lookback_days < 1:
            raise ValueError(f"lookback_days must be at least 1, got {self.lookback_days}")
        if not self.workspace_filter:
            raise ValueError(f"workspace_filter must be a workspace id or {ALL_WORKSPACES!r}")
        for name in ("cpu_threshold", "io_wait_threshold", "memory_threshold", "swap_threshold"):
            if not 0 <= getattr(self, name) <= 100:
                raise ValueError(f"{name} must be a percentage, got {getattr(self, name)}")
        for name in ("driver_cpu_threshold", "driver_memory_gb_threshold", "vm_threshold_default"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative, got {getattr(self, name)}")
        for letter, generation in self.vm_thresholds.items():
            if len(letter) != 1 or not ("A" <= letter <= "Z") or generation < 0:
                raise ValueError(f"vm_thresholds maps a capital letter to a generation, got {letter!r}: {generation!r}")

    @property
    def window_start(self) -> date:
        """First day of the lookback window; its midnight is included."""
        return self.as_of - timedelta(days=self.lookback_days)

    @classmethod
    def from_params(cls, params: Mapping[str, str | int | date]) -> AnalysisConfig:
        """Build a configuration from flat, possibly textual parameters, e.g. notebook or job parameters.

        Each VM series has a parameter of its own, such as ``vm_threshold_D``.
        """
        types = {f.name: f.type for f in fields(cls)}
        values: dict = {}
        thresholds = dict(DEFAULT_VM_THRESHOLDS)
        for name, value in params.items():
            if name in _INERT:
                continue
            letter = name.removeprefix("vm_threshold_")
            if name not in types and letter in thresholds and letter != name:
                thresholds[letter] = int(value)
            elif name == "as_of":
                values[name] = date.fromisoformat(value) if isinstance(value, str) else value
            elif types.get(name) == "bool":
                if str(value).lower() not in ("true", "false"):
                    raise ValueError(f"{name} must be true or false, got {value!r}")
                values[name] = str(value).lower() == "true"
            elif types.get(name) == "int":
                values[name] = int(value)
            elif name in types and name != "vm_thresholds":
                values[name] = value
            else:
                raise ValueError(f"unknown parameter {name!r}")
        return cls(vm_thresholds=MappingProxyType(thresholds), **values)
