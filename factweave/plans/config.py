"""Settings: limits, switches, weights; read from TOML, unknown keys are errors."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path

#: Numbers that are no magic numbers.
PLAIN_NUMBERS = ("0", "1", "-1", "2", "0.0", "1.0")
TOLERANCE = 0.001


class ConfigError(ValueError):
    """A file that is no TOML, holds a key that isn't known, or weights that don't sum to 1."""


@dataclass(frozen=True)
class Complexity:
    enabled: bool = True
    max_cognitive: int = 15
    max_cyclomatic: int = 10
    max_nesting_depth: int = 4
    max_function_lines: int = 60
    include_nesting_penalty: bool = True
    detect_magic_numbers: bool = True
    detect_unsafe: bool = True
    detect_error_handling: bool = True
    allow_expect: bool = False
    allowed_magic_numbers: tuple[str, ...] = PLAIN_NUMBERS


@dataclass(frozen=True)
class Duplicates:
    enabled: bool = True
    similarity_threshold: float = 0.85
    min_tokens: int = 30
    min_lines: int = 5
    min_statements: int = 3
    ignore_tests: bool = True
    ignore_trait_impls: bool = True
    detect_dead_code: bool = True
    detect_wildcard_imports: bool = True
    detect_repeated_matches: bool = True


@dataclass(frozen=True)
class Boilerplate:
    enabled: bool = True
    patterns: tuple[str, ...] = ()
    suggest_crates: bool = True


@dataclass(frozen=True)
class Srp:
    enabled: bool = True
    smell_threshold: float = 0.6
    max_fields: int = 12
    max_methods: int = 20
    max_fan_out: int = 10
    lcom4_threshold: int = 2
    weights: tuple[float, ...] = (0.4, 0.25, 0.15, 0.2)
    file_length_baseline: int = 300
    file_length_ceiling: int = 800
    max_independent_clusters: int = 2
    min_cluster_statements: int = 5
    max_parameters: int = 5


@dataclass(frozen=True)
class Coupling:
    enabled: bool = True
    max_instability: float = 0.8
    max_fan_in: int = 15
    max_fan_out: int = 12
    check_sdp: bool = True


@dataclass(frozen=True)
class Structural:
    enabled: bool = True
    check_btc: bool = True
    check_slm: bool = True
    check_nms: bool = True
    check_oi: bool = True
    check_sit: bool = True
    check_deh: bool = True
    check_iet: bool = True


@dataclass(frozen=True)
class TestQuality:
    enabled: bool = True
    coverage_file: str | None = None
    extra_assertion_macros: tuple[str, ...] = ()


@dataclass(frozen=True)
class Weights:
    iosp: float = 0.22
    complexity: float = 0.18
    dry: float = 0.13
    srp: float = 0.18
    coupling: float = 0.09
    test_quality: float = 0.10
    architecture: float = 0.10


@dataclass(frozen=True)
class Config:
    ignore_functions: tuple[str, ...] = ()
    exclude_files: tuple[str, ...] = ()
    strict_closures: bool = False
    strict_iterator_chains: bool = False
    allow_recursion: bool = False
    strict_error_propagation: bool = False
    max_suppression_ratio: float = 0.05
    fail_on_warnings: bool = False
    complexity: Complexity = field(default_factory=Complexity)
    duplicates: Duplicates = field(default_factory=Duplicates)
    boilerplate: Boilerplate = field(default_factory=Boilerplate)
    srp: Srp = field(default_factory=Srp)
    coupling: Coupling = field(default_factory=Coupling)
    structural: Structural = field(default_factory=Structural)
    test_quality: TestQuality = field(default_factory=TestQuality)
    weights: Weights = field(default_factory=Weights)


def _filled(kind, values: dict, where: str = ""):
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise ConfigError(f"unknown {where}{unknown[0]}")
    base, out = kind(), {}
    for name, value in values.items():
        old = getattr(base, name)
        if is_dataclass(old):
            if not isinstance(value, dict):
                raise ConfigError(f"{name} is no table")
            value = _filled(type(old), value, f"{name}.")
        elif isinstance(old, tuple):
            value = tuple(value)
        elif isinstance(old, float) and isinstance(value, int):
            value = float(value)
        if old is not None and not is_dataclass(old) and type(value) is not type(old):
            raise ConfigError(f"{where}{name} is {type(value).__name__}, not {type(old).__name__}")
        out[name] = value
    return replace(base, **out)


def parse(text: str) -> Config:
    """Settings of a TOML text; what it doesn't say keeps its default."""
    try:
        config = _filled(Config, tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    check_weights(config.weights)
    return config


def check_weights(w: Weights) -> None:
    total = sum(getattr(w, f.name) for f in fields(w))
    if abs(total - 1) > TOLERANCE:
        raise ConfigError(f"weights sum to {total:.4f}, not to 1")


def load(start: str, name: str, explicit: str | None = None) -> Config:
    """From the file that is named, else the first file of that name in a folder or those above it, else the defaults."""
    if explicit:
        return parse(Path(explicit).read_text())
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        if (folder / name).is_file():
            return parse((folder / name).read_text())
    return Config()
