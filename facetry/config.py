"""Settings, their precedence, and logging."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, fields, replace
from datetime import datetime
from logging.handlers import RotatingFileHandler
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Settings of the feature extractors."""

    do_chunking: bool = False
    chunk_size: int = 128
    chunk_overlap: int = 32
    doc_agg: str = "max"
    chunk_agg: str = "max"
    threshold: float = 0.5
    top_tokens: int = 20
    n_features: int = 256
    k: int = 8
    excluded_token: int | None = None


def merged(*parts: dict | None) -> dict:
    """One dict of several, the last value of a key holds."""
    out: dict = {}
    for p in parts:
        out.update(p or {})
    return out


def strict(cls, values: dict):
    """``cls`` built from ``values``; a key it doesn't have raises ValueError."""
    unknown = set(values) - {f.name for f in fields(cls)}
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}; there are {sorted(f.name for f in fields(cls))}")
    return cls(**values)


def load_section(path: str, section: str) -> dict:
    """A section of a YAML file; a missing file or section raises."""
    import yaml

    if not Path(path).exists():
        raise FileNotFoundError(path)
    found = (yaml.safe_load(Path(path).read_text()) or {}).get(section)
    if not found:
        raise ValueError(f"no section {section!r} in {path}")
    return found


def settings(method: str, path: str | None = None, section: str = "mte", **given) -> Settings:
    """What is ``given`` comes before the section of the method (``emb`` or ``llm``), that before ``gen``.

    Keys of a file that are no settings are left out, as files hold those of models too; one that is
    ``given`` raises ValueError.
    """
    method = method.lower()
    if method not in ("emb", "llm"):
        raise ValueError(f"unknown method {method!r}; there are emb and llm")
    names = {f.name for f in fields(Settings)}
    base = load_section(path, section) if path else {}
    read = {k: v for k, v in merged(base.get("gen"), base.get(method)).items() if k in names}
    return strict(Settings, merged(read, {k: v for k, v in given.items() if v is not None}))


def chunk_limits(s: Settings, model_limit: int | None) -> Settings:
    """Chunks no longer than the model reads; an overlap that no longer fits becomes a quarter."""
    size = min(s.chunk_size, model_limit) if model_limit else s.chunk_size
    overlap = s.chunk_overlap if s.chunk_overlap < size else int(0.25 * size)
    return replace(s, chunk_size=size, chunk_overlap=overlap)


def for_layer(sae_id: str, layer: int) -> str:
    """The id of an autoencoder with its leading layer number replaced."""
    return re.sub(r"^\d+-", f"{layer}-", sae_id)


def logger(name: str, folder: str | None = None, level: str = "INFO", keep: int = 5) -> logging.Logger:
    """A logger to the console and, with ``folder``, to a dated file of which the latest ``keep`` stay."""
    log = logging.getLogger(name)
    log.setLevel(level)
    if log.handlers:
        return log
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        old = sorted(Path(folder).glob(f"{name}-*.log"))
        for f in old[: max(0, len(old) - keep + 1)]:
            f.unlink()
        handlers.append(RotatingFileHandler(f"{folder}/{name}-{datetime.now():%Y-%m-%d_%H-%M-%S}.log", maxBytes=1 << 24, backupCount=keep))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(h)
    return log
