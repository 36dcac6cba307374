"""Settings from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from .schema import CATEGORIES

PREFIX = "FOLIOFLOW_"


def number(env: Mapping[str, str], name: str, default: float) -> float:
    """A number; the default where there is none or it can't be read."""
    try:
        return float(env.get(name, ""))
    except ValueError:
        return default


@dataclass
class Config:
    language_provider: str = "none"
    speech_provider: str = "none"
    workspaces_root: str = "workspaces"
    loudness_enabled: bool = True
    loudness_target_lufs: float = -18.0
    loudness_peak_dbfs: float = -1.0
    loudness_max_gain_db: float = 30.0
    speech_params: dict[str, object] = field(default_factory=dict)
    voice_defaults: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        env = os.environ if env is None else env
        c = cls()
        c.language_provider = env.get(f"{PREFIX}LANGUAGE", c.language_provider)
        c.speech_provider = env.get(f"{PREFIX}SPEECH", c.speech_provider)
        c.workspaces_root = env.get(f"{PREFIX}WORKSPACES", c.workspaces_root)
        if (on := env.get(f"{PREFIX}LOUDNESS")) is not None:
            c.loudness_enabled = on.strip().lower() not in ("0", "false", "no", "off")
        c.loudness_target_lufs = number(env, f"{PREFIX}LOUDNESS_TARGET", c.loudness_target_lufs)
        c.loudness_peak_dbfs = number(env, f"{PREFIX}LOUDNESS_PEAK", c.loudness_peak_dbfs)
        c.loudness_max_gain_db = number(env, f"{PREFIX}LOUDNESS_GAIN", c.loudness_max_gain_db)
        keys = [*[k for k in CATEGORIES if k != "unknown"], "default"]
        c.voice_defaults = {k: v for k in keys if (v := env.get(f"{PREFIX}VOICE_{k.upper()}"))}
        return c

    def project_params(self) -> dict[str, object]:
        """What a new project keeps for speech: the settings, and its own copy of the loudness settings."""
        block = {"enabled": self.loudness_enabled, "target_lufs": self.loudness_target_lufs, "peak_ceiling_dbfs": self.loudness_peak_dbfs, "max_gain_db": self.loudness_max_gain_db}
        return {**self.speech_params, "loudness": block}
