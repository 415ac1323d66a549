"""Run settings from a Python file that defines ``config`` or ``make_config()``."""

from __future__ import annotations

import runpy
from dataclasses import dataclass, field


@dataclass
class Config:
    """What the data plane needs of a run's settings; others go to ``extra``."""

    dataset: str = ""
    block_size: int = 512
    batch_size: int = 32
    vocab_size: int = 8192
    epochs: float = 1.0
    seed: int = 1337
    extra: dict = field(default_factory=dict)


def load(path: str) -> Config:
    """The file's settings; an error if it defines none."""
    found = runpy.run_path(path)
    if callable(found.get("make_config")):
        return found["make_config"]()
    if "config" in found:
        return found["config"]
    raise AttributeError(f"{path} defines neither config nor make_config()")
