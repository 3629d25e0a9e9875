"""User configuration: templates, fields, automations and thresholds, small and parsed on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

#: The states of a document.
STATES = ("recebido", "processando", "em_revisao", "concluido", "quarentena", "falha")

#: The allowed state changes; there are no loops.
TRANSITIONS = {
    "recebido": ("processando", "quarentena", "falha"),
    "processando": ("em_revisao", "concluido", "quarentena", "falha"),
    "em_revisao": ("processando", "concluido", "quarentena", "falha"),
    "quarentena": ("processando",),
    "falha": ("processando",),
    "concluido": ("processando",),
}


@dataclass(frozen=True)
class Thresholds:
    match: float = 0.5
    ambiguity_gap: float = 0.1
    quality: float = 0.8
    native_text_chars: int = 16
    name_length: int = 200
    quiet_seconds: float = 4.0


@dataclass(frozen=True)
class Condition:
    """One signal of a template: mode `texto` (default) or `regex`."""

    mode: str
    value: str


@dataclass(frozen=True)
class TemplateField:
    name: str
    field_type: str = "texto"
    required: bool = False
    regex: str | None = None


@dataclass(frozen=True)
class Template:
    template_id: int
    name: str
    groups: tuple[tuple[Condition, ...], ...] = ()
    fields: tuple[TemplateField, ...] = ()


@dataclass(frozen=True)
class RuleCondition:
    """field: field, source_folder, extension, filename, size or template; operator: eq, contains, gt or lt."""

    field: str
    operator: str
    value: str
    field_name: str | None = None


@dataclass(frozen=True)
class Rule:
    rule_id: int
    priority: int
    conditions: tuple[RuleCondition, ...] = ()
    conjunction: str = "and"
    active: bool = True


@dataclass(frozen=True)
class Action:
    """rename (name_pattern), move or copy (dest_folder)."""

    position: int
    action_type: str
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Automation:
    automation_id: int
    position: int
    conditions: tuple[RuleCondition, ...] = ()
    actions: tuple[Action, ...] = ()
    active: bool = True


def parse_groups(signals_json: str | None) -> tuple[tuple[Condition, ...], ...]:
    """Signal groups from JSON. A flat list of strings is one group per string; whatever is malformed is dropped."""
    try:
        found = json.loads(signals_json or "[]")
    except ValueError:
        return ()
    rows = found if isinstance(found, list) else []
    if all(isinstance(row, str) for row in rows):
        rows = [[{"value": row}] for row in rows]
    signal = lambda c: Condition(*(str(c.get(k) or default) for k, default in (("mode", "texto"), ("value", ""))))
    return tuple(tuple(signal(c) for c in row if isinstance(c, dict)) for row in rows if isinstance(row, list))


def normalize_extensions(raw: str | list | None) -> list[str]:
    """`.ext` in small letters, in order, each once, from a list or a text separated by commas, semicolons or space."""
    typed = re.findall(r"[^,;\s]+", raw) if isinstance(raw, str) else [str(x).strip() for x in raw or ()]
    dotted = (re.sub(r"^(?!\.)", ".", x.casefold()) for x in typed if x)
    return list(dict.fromkeys(dotted))
