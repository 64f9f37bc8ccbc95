"""A library's settings from YAML, with defaults and checks."""

from dataclasses import dataclass, field, fields

import yaml


@dataclass(frozen=True)
class Config:
    """Settings of a run. Shares are between 0 and 1, counts positive."""

    target: str = "zh"
    categories: tuple[str, ...] = ()
    aliases: dict[str, str | None] = field(default_factory=dict)
    minutes: int = 50
    most_pictures: int = 60
    most_bytes: int = 40 << 20
    han_share: float = 0.3
    models: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        bad = [n for n in ("minutes", "most_pictures", "most_bytes") if not isinstance(getattr(self, n), int) or getattr(self, n) < 1]
        if not 0 <= self.han_share <= 1:
            bad.append("han_share")
        if bad:
            raise ValueError(f"out of range: {', '.join(bad)}")
        keys = [k.lower() for k in self.aliases]
        if len(set(keys)) < len(keys):
            raise ValueError("two aliases name one tag")
        for source, target in self.aliases.items():
            onward = self.aliases.get((target or "").lower(), target)
            if target and onward != target:
                raise ValueError(f"alias {source} leads to {target}, which is an alias too")

    def model(self, task: str) -> str | None:
        return self.models.get(task, self.models.get("default"))


def read(text: str) -> Config:
    data = yaml.safe_load(text) or {}
    known = {f.name for f in fields(Config)}
    if unknown := set(data) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})
