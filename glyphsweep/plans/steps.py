"""Which cleaning steps a run takes."""

from __future__ import annotations

from collections.abc import Iterable

from glyphsweep.rules import STEPS


def parse_step_list(value: str) -> list[str]:
    """Step names from comma-separated text: trimmed, lower-case, without repeats."""
    names = (part.strip().lower() for part in value.split(","))
    return list(dict.fromkeys(n for n in names if n))


def select_steps(
    only: Iterable[str] | str = (), skip: Iterable[str] | str = ()
) -> tuple[str, ...]:
    """The steps to run, in canonical order whatever order was asked for."""
    wanted = parse_step_list(only) if isinstance(only, str) else list(only)
    dropped = parse_step_list(skip) if isinstance(skip, str) else list(skip)
    if wanted and dropped:
        raise ValueError("only and skip exclude each other")
    unknown = [n for n in (*wanted, *dropped) if n not in STEPS]
    if unknown:
        raise ValueError(f"unknown step {unknown[0]!r} (valid: {', '.join(STEPS)})")
    steps = tuple(s for s in STEPS if (s in wanted if wanted else s not in dropped))
    if not steps:
        raise ValueError("skip leaves no step to run")
    return steps
