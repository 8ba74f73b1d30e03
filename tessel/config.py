"""Settings of a crawl: values from a file, each open to an environment variable of the same name."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Config:
    """sources: which ones are on. Times in days and seconds; most_per_run of None means no limit."""

    store: str = "store"
    sources: Mapping[str, bool] = field(default_factory=dict)
    recrawl_after_days: float = 30.0
    most_per_run: int | None = None
    start_from: int = 0
    save_every: int = 1000

    def __post_init__(self):
        for name in ("start_from", "save_every"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} is negative")

    @classmethod
    def of(cls, values: Mapping, environment: Mapping[str, str] | None = None, prefix: str = "TESSEL_") -> Config:
        """From a mapping; TESSEL_STORE and the like, JSON or plain text, go before it. Names that it doesn't know fail."""
        known = {f.name for f in fields(cls)}
        if odd := set(values) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(odd))}")
        found = dict(values)
        for name in known:
            if (told := (os.environ if environment is None else environment).get(prefix + name.upper())) is not None:
                try:
                    found[name] = json.loads(told)
                except ValueError:
                    found[name] = told
        return cls(**found)

    @classmethod
    def read(cls, path: str, environment: Mapping[str, str] | None = None) -> Config:
        """From a JSON file, or a YAML one where a YAML parser is installed."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.of(yaml.safe_load(text) or {}, environment)
        return cls.of(json.loads(text or "{}"), environment)
