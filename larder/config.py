"""Settings of a run, read once; no module-level state."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Folders and parameters. ``from_environment`` takes LARDER_<NAME> where set."""

    input_dir: str = "data"
    output_dir: str = "warehouse"
    as_of: str = "9999-12-31 00:00:00"
    bot_rows_per_day: int = 50
    pseudo_count: float = 10.0
    rebuild: bool = False

    @classmethod
    def from_mapping(cls, values: Mapping[str, str]) -> Config:
        """LARDER_<NAME> where given, else the default."""
        given = {}
        for f in fields(cls):
            v = values.get(f"LARDER_{f.name.upper()}")
            if v is not None:
                given[f.name] = v.lower() in ("1", "true", "yes") if isinstance(f.default, bool) else type(f.default)(v)
        return cls(**given)

    @classmethod
    def from_environment(cls) -> Config:
        return cls.from_mapping(os.environ)
