"""Load options (driver side) and their validation."""

from __future__ import annotations

from dataclasses import dataclass, field


def parse_patterns(csv: str | None) -> tuple[str, ...]:
    """Comma-separated glob list: split on ',', strip, drop empties."""
    if not csv:
        return ()
    return tuple(p.strip() for p in csv.split(",") if p.strip())


@dataclass(frozen=True)
class LoadOptions:
    """How a diff is cut into chunks. Defaults follow the reference tool."""

    max_chunk_lines: int = 1000
    skip_trivial: bool = True
    skip_generated: bool = True
    include_patterns: tuple[str, ...] = field(default_factory=tuple)
    exclude_patterns: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self):
        m = self.max_chunk_lines
        if isinstance(m, bool) or not isinstance(m, int) or m <= 0:
            raise ValueError("max_chunk_lines must be a positive integer")
        for name in ("include_patterns", "exclude_patterns"):
            value = getattr(self, name)
            if value is None:
                object.__setattr__(self, name, ())
            elif isinstance(value, str):
                object.__setattr__(self, name, parse_patterns(value))
            else:
                object.__setattr__(self, name, tuple(p.strip() for p in value if p and p.strip()))

    @classmethod
    def from_strings(cls, max_chunk_lines: int = 1000, skip_trivial: bool = True, skip_generated: bool = True,
                     include_patterns: str | None = None, exclude_patterns: str | None = None) -> "LoadOptions":
        return cls(max_chunk_lines, skip_trivial, skip_generated,
                   parse_patterns(include_patterns), parse_patterns(exclude_patterns))


def check_chunk_number(chunk_number) -> int:
    if isinstance(chunk_number, bool) or not isinstance(chunk_number, int) or chunk_number <= 0:
        raise ValueError("chunk_number must be a positive integer")
    return chunk_number


def check_pattern(pattern) -> str:
    if not isinstance(pattern, str) or not pattern.strip():
        raise ValueError("Pattern must be a non-empty string")
    return pattern.strip()
