"""Typed settings: a TOML file, defaults for what it lacks, and dotted overrides. Read on the driver only."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

#: Fixed values, here and in the classes below: names of engines, services, sections and keys of a settings file, their defaults and limits.
OCR_ENGINES = ("auto", "ocrmypdf", "paddleocr", "tesseract", "easyocr")
PROVIDERS = ("rule", "openai-compatible", "ollama", "local")
DEFAULT_FILE = "quirelake.toml"


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class OcrSettings:
    engine: str = "auto"
    language: str = "tur"
    dpi: int = 300
    gpu: bool = False
    split_double_pages: bool = True

    def __post_init__(self) -> None:
        _require(self.engine in OCR_ENGINES, f"no engine {self.engine!r}")
        _require(150 <= self.dpi <= 600, "dpi must be between 150 and 600")


@dataclass(frozen=True)
class ModelSettings:
    provider: str = "rule"
    base_url: str = "http://localhost:11434"
    api_key: str | None = None
    model: str = "qwen3:8b"
    command: tuple[str, ...] = ()
    timeout_seconds: int = 120

    def __post_init__(self) -> None:
        _require(self.provider in PROVIDERS, f"no provider {self.provider!r}")
        _require(self.timeout_seconds >= 5, "timeout_seconds must be 5 or more")
        object.__setattr__(self, "command", tuple(self.command))


@dataclass(frozen=True)
class BookSettings:
    title: str = "Untitled"
    author: str = "Unknown"
    language: str = "tr"
    cover: str | None = None
    publisher: str | None = None
    style_path: str | None = None


@dataclass(frozen=True)
class RunSettings:
    workers: int = 1
    cache_dir: str = ".cache"
    keep_temp: bool = False

    def __post_init__(self) -> None:
        _require(self.workers >= 1, "workers must be 1 or more")


@dataclass(frozen=True)
class Settings:
    ocr: OcrSettings = field(default_factory=OcrSettings)
    ai: ModelSettings = field(default_factory=ModelSettings)
    epub: BookSettings = field(default_factory=BookSettings)
    performance: RunSettings = field(default_factory=RunSettings)

    @classmethod
    def of(cls, data: Mapping[str, Mapping[str, object]]) -> Settings:
        """Settings from nested maps; unknown sections and keys are passed over, wrong types are errors."""
        parts = {}
        for section in fields(cls):
            kind = section.default_factory
            given = data.get(section.name) or {}
            known = {f.name: f for f in fields(kind)}
            values = {k: v for k, v in given.items() if k in known}
            for k, v in values.items():
                default = getattr(kind(), k)
                if isinstance(default, bool) != isinstance(v, bool) or isinstance(default, int) and not isinstance(v, int):
                    raise ValueError(f"{section.name}.{k} can't be {v!r}")
            parts[section.name] = kind(**values)
        return cls(**parts)

    @classmethod
    def load(cls, path: str | None = None) -> Settings:
        """From a file; without one from DEFAULT_FILE in the working folder; a file that isn't there gives the defaults."""
        p = Path(path or DEFAULT_FILE)
        return cls.of(tomllib.loads(p.read_text(encoding="utf-8"))) if p.exists() else cls()

    def merged(self, overrides: Mapping[str, object]) -> Settings:
        """With ``section.key`` values replaced; a value of None leaves what there is."""
        data = asdict(self)
        for dotted, value in overrides.items():
            if value is not None:
                section, key = dotted.split(".", 1)
                data.setdefault(section, {})[key] = value
        return Settings.of(data)
