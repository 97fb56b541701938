"""Study documents: paths from arguments, environment or defaults; segments; a hash of what was used."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date
from pathlib import Path
from typing import Any

from .artifacts import Artifacts, content_hash
from .study_rules import ConfigError, resolve

#: The only names that a document may refer to, and the blocks that it may have.
PATHS = ("DATA_DIR", "PROVIDER_URI", "ARTIFACT_ROOT")
BLOCKS = ("study", "qlib_init", "data_handler", "segments", "model", "backtest")
_REFERENCE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


class Paths:
    """Directories by name: what is given, else the environment's, else ``root`` / default. Remembers what was overridden."""

    def __init__(self, root: str | Path, environ: Mapping[str, str] | None = None, **given: str | Path):
        self.root, self.environ, self.given = Path(root).absolute(), os.environ if environ is None else environ, given
        self.overrides: dict[str, str] = {}

    def __call__(self, name: str, default: str) -> Path:
        if name not in PATHS:
            raise ConfigError(f"{name} is no path of a study; known: {', '.join(PATHS)}")
        value = self.given.get(name, self.environ.get(name))
        if value is None:
            return self.root / default
        if not str(value).strip():
            raise ConfigError(f"{name} is set but empty")
        path = Path(str(value).strip()).expanduser()
        if not path.is_absolute() or path.is_file():
            raise ConfigError(f"{name} has to be the absolute path of a folder, not {value!r}")
        self.overrides[name] = path.as_posix()
        return path

    def expand(self, text: str) -> str:
        """Replaces ${NAME} and ${NAME:-default}; a default is an absolute path, or ``artifacts`` for ARTIFACT_ROOT."""

        def value(m: re.Match) -> str:
            name, default = m[1], (m[2] or "").strip()
            if m[2] is not None and not (Path(default).is_absolute() or (name, default) == ("ARTIFACT_ROOT", "artifacts")):
                raise ConfigError(f"the default of {name} has to be an absolute path, not {default!r}")
            return self(name, default or {"ARTIFACT_ROOT": "artifacts"}.get(name, "data")).as_posix()

        return _REFERENCE.sub(value, text)


@dataclass(frozen=True)
class Segments:
    """Closed ranges of dates that follow each other, and how many positions before the next one are purged."""

    train: tuple[str, str]
    valid: tuple[str, str]
    test: tuple[str, str]
    purge_radius: int = 0

    def __post_init__(self) -> None:
        try:
            days = [date.fromisoformat(d) for pair in (self.train, self.valid, self.test) for d in pair]
        except (TypeError, ValueError) as e:
            raise ConfigError(f"segments need ISO dates: {e}") from e
        if len(days) != 6 or any(days[k] > days[k + 1] for k in (0, 2, 4)) or any(days[k] >= days[k + 1] for k in (1, 3)):
            raise ConfigError("segments have to be three pairs of dates in order, without overlap")
        if self.purge_radius < 0:
            raise ConfigError("purge_radius can't be negative")


@dataclass(frozen=True)
class Study:
    document: Mapping[str, Any]
    overrides: Mapping[str, str]
    values: Mapping[str, Any]  # all of them by dotted path, defaults included

    @property
    def name(self) -> str:
        return self.values["study.name"]

    @property
    def seed(self) -> int:
        return self.values["study.seed"]

    @property
    def segments(self) -> Segments:
        each = (tuple(map(str, self.values[f"segments.{k}"])) for k in ("train", "valid", "test"))
        return Segments(*each, purge_radius=self.values["segments.purge_radius"])

    @property
    def hash(self) -> str:
        """Of the document with the paths that were overridden."""
        return content_hash({"document": self.document, "overrides": self.overrides})

    def dump(self, folder: str | Path) -> Path:
        return Artifacts(folder).save("resolved_config.yaml", {**self.document, "overrides": dict(self.overrides)})


def load_study(path: str | Path, paths: Paths, *, allow_zero_cost: bool = False) -> Study:
    """Reads a YAML document, with its paths filled in; missing or unknown blocks and values, and such that can't be used, are errors."""
    import yaml

    document = yaml.safe_load(paths.expand(Path(path).read_text(encoding="utf-8")))
    if not isinstance(document, Mapping):
        raise ConfigError(f"{path} holds no mapping")
    if unknown := set(document) - set(BLOCKS):
        raise ConfigError(f"unknown blocks: {', '.join(sorted(map(str, unknown)))}")
    study = Study(document, dict(paths.overrides), resolve(document, allow_zero_cost=allow_zero_cost))
    study.segments  # noqa: B018  checks their order
    return study
