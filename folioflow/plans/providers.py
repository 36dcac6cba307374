"""Providers by name: a run names those it wants, a deployment says how they are made."""

from __future__ import annotations

from collections.abc import Callable

from ..config import Config
from ..errors import ConfigError, PreconditionError
from ..operators.attribute import LanguageProvider
from ..operators.render import Speech

_language: dict[str, Callable[[Config], LanguageProvider]] = {}
_speech: dict[str, Callable[[Config], Speech]] = {}


def register_language(name: str, make: Callable[[Config], LanguageProvider]) -> None:
    _language[name.lower()] = make


def register_speech(name: str, make: Callable[[Config], Speech]) -> None:
    _speech[name.lower()] = make


def _made(table: dict, kind: str, name: str, config: Config):
    if name.lower() not in table:
        raise ConfigError(f"no {kind} provider is named {name!r}; there are: {', '.join(sorted(table)) or 'none'}")
    make = table[name.lower()]
    return lambda: make(config)


def language(config: Config, name: str | None = None, needed: bool = False) -> Callable[[], LanguageProvider]:
    """A maker, to be called once in each task. With `needed` the provider has to answer now."""
    make = _made(_language, "language", name or config.language_provider, config)
    if needed and not make().is_available():
        raise PreconditionError(f"the language provider {name or config.language_provider!r} isn't available")
    return make


def speech(config: Config, name: str | None = None) -> Callable[[], Speech]:
    return _made(_speech, "speech", name or config.speech_provider, config)
