"""Settings of a task: defaults, overrides, and which features go where."""

from __future__ import annotations

from ..operators.atoms import ATOMS

#: Orders in which the tasks are run.
TASKS = tuple(ATOMS)


def merge(defaults: dict, overrides: dict[str, dict], task: str) -> dict:
    """Defaults with a task's own settings over them."""
    if task not in TASKS:
        raise ValueError(f"unknown task: {task}")
    return defaults | overrides.get(task, {})


def wire(decoder: list[str], symbolic: list[str], coupled: bool) -> tuple[list[str], list[str]]:
    """What the decoder and the channels read: coupled, both read all; apart, each its own, the decoder the channels' if it has none."""
    both = list(dict.fromkeys([*decoder, *symbolic]))
    return (both, both) if coupled else (decoder or symbolic, symbolic)


def spec_path(task: str, dataset: str, template: str | None = None, path: str | None = None) -> str | None:
    """Where a task's spec is; a template with ``{task}`` and ``{dataset}`` goes before a path."""
    return template.format(task=task, dataset=dataset) if template else path
