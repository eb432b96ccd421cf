"""Line formats, phases and components from a file, in front of those that come with the engine."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from tidemark.functions.parsers import FIELDS, FORMATS
from tidemark.functions.text import PHASES
from tidemark.sources.archives import COMPONENTS

KINDS = ("WALL", "MONOTONIC", "BOOT_RELATIVE", "NONE")
#: what a group of a format may hold
GROUPS = {*FIELDS, "level", "level_cn", "klevel", "host", "ecu", "app", "ctx"} - {"ts_kind", "level_raw", "level_norm", "fields", "status"}


class RulesError(ValueError):
    pass


@dataclass(frozen=True)
class Rules:
    formats: list = field(default_factory=lambda: FORMATS)
    phases: list = field(default_factory=lambda: PHASES)
    components: list = field(default_factory=lambda: COMPONENTS)


def load_rules(path: str) -> Rules:
    """Rules of a JSON or YAML file: `parsers` (name, ts_kind, regex with named groups), `phases` (name, regex), `components` (directory, name, rank).

    Each list goes before the engine's own, in its order. Raises RulesError for a rule that can't work.
    """
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text) or {}
    formats = []
    for rule in found.get("parsers", []):
        try:
            names = list(re.compile(rule["regex"]).groupindex)
            groups = re.compile(rule["regex"]).groups
        except (re.error, KeyError) as e:
            raise RulesError(f"{rule.get('name')}: {e}") from None
        if len(names) != groups or set(names) - GROUPS or rule.get("ts_kind", "WALL") not in KINDS or not names:
            raise RulesError(f"{rule.get('name')}: every group is named after one of {', '.join(sorted(GROUPS))}, ts_kind is one of {', '.join(KINDS)}")
        formats.append((rule["name"], rule.get("ts_kind", "WALL"), re.sub(r"\(\?P<\w+>", "(", rule["regex"]), names))
    phases = [(p["name"], p["regex"]) for p in found.get("phases", [])]
    components = [(c["directory"], c["name"], int(c.get("rank", 999))) for c in found.get("components", [])]
    return Rules([*formats, *FORMATS], [*phases, *PHASES], [*components, *COMPONENTS])
