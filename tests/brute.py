"""Plain Python models of operators that SQL can't express; for small inputs."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

US = timedelta(microseconds=1)
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
TIME = r"(?P<h>\d{1,2}):(?P<mi>\d\d):(?P<s>\d\d)(?:[.,](?P<f>\d+))?\s*(?P<ap>[AP]M)?\s*(?P<z>.*)"
LAYOUTS = [
    r"(?P<y>\d{4})[-/](?P<mo>\d\d)[-/](?P<d>\d\d)[T ]" + TIME,
    r"(?P<y>\d{4})(?P<mo>\d\d)(?P<d>\d\d)T(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)(?P<f>)(?P<ap>)(?P<z>Z)",
    r"(?P<d>\d\d)\.(?P<mo>\d\d)\.(?P<y>\d{4}) " + TIME,
    r"(?P<y>\d{4})年(?P<mo>\d\d)月(?P<d>\d\d)日 (?P<h>\d{1,2})时(?P<mi>\d\d)分(?P<s>\d\d)秒(?P<f>)(?P<ap>)(?P<z>)",
    r"[A-Z][a-z]{2}, (?P<d>\d\d) (?P<mo>[A-Z][a-z]{2}) (?P<y>\d{4}) " + TIME,
    r"(?P<mo>[A-Z][a-z]{2}) (?P<d>\d{1,2}), (?P<y>\d{4}) " + TIME,
    r"(?P<y>)(?P<mo>\d\d)-(?P<d>\d\d) " + TIME,
    r"(?P<y>)(?P<mo>\d\d)(?P<d>\d\d) " + TIME,
    r"(?P<y>)(?P<mo>[A-Z][a-z]{2}) +(?P<d>\d{1,2}) " + TIME,
]


def us(t: datetime) -> int:
    return (t - EPOCH) // US


def instants(raw: str | None, zone: str | None, collected: datetime | None) -> tuple[int, int] | None:
    text = (raw or "").strip()
    if m := re.fullmatch(r"(\d+)(?:\.(\d+))?", text):
        if len(m[1]) <= 11:
            return (int(m[1]) * 10**6 + int((m[2] or "").ljust(6, "0")[:6] or 0),) * 2
        return None if m[2] else (int(m[1]) * (1000 if len(m[1]) <= 14 else 1),) * 2
    for layout in LAYOUTS:
        if m := re.fullmatch(layout, text):
            break
    else:
        return None
    month = MONTHS.index(m["mo"].lower()) + 1 if m["mo"].lower() in MONTHS else m["mo"]
    hour = int(m["h"])
    if m["ap"]:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (m["ap"] == "PM")
    z = m["z"].strip("[]")
    offset = None
    if z in ("Z", "UTC", "GMT"):
        offset = 0
    elif o := re.fullmatch(r"([+-])(\d\d):?(\d\d)?", z):
        offset = (-1 if o[1] == "-" else 1) * (int(o[2]) * 60 + int(o[3] or 0))
    years = [int(m["y"])] if m["y"] else [collected.year + 1 - i for i in range(10)] if collected else []
    for year in years:
        try:
            t = datetime(year, int(month), int(m["d"]), hour, int(m["mi"]), int(m["s"]), int((m["f"] or "").ljust(6, "0")[:6]))
        except ValueError:
            continue
        if offset is not None:
            both = (us(t.replace(tzinfo=timezone.utc)) - offset * 60 * 10**6,) * 2
        else:
            key = z or zone
            if not key:
                return None
            a, b = (us(t.replace(tzinfo=ZoneInfo(key), fold=f).astimezone(timezone.utc)) for f in (0, 1))
            both = (a, max(a, b) if a < b else a)
        if m["y"] or both[0] <= us(collected) + 86_400 * 10**6:
            return both
    return None


def utc_of(stamps: list[dict], anchors: list[dict], places: dict[int, tuple[str, datetime]]) -> dict[int, int]:
    best = {}
    for a in sorted(anchors, key=lambda a: (-a["weight"], a["anchor_id"])):
        best.setdefault(a["boot_id"], a)
    files = defaultdict(dict)
    for r in stamps:
        files[r["file_id"]][r["rec_id"]] = r
    out = {}
    for f, rows in files.items():
        before = None
        for r in sorted(rows.values(), key=lambda r: (r["line_no"], r["rec_id"])):
            mono = r["mono_s"]
            if mono is not None and not math.isnan(mono):
                if (a := best.get(r["boot_id"])) is None:
                    continue
                at = (us(a["wall_utc"]) * 1000 + round(mono * 10**6) * 1000 - a["monotonic_ns"]) // 1000
            else:
                if (both := instants(r["ts_raw"], *places.get(f, (None, None)))) is None:
                    continue
                at = both[1] if before is not None and both[0] < before - 60 * 10**6 else both[0]
            out[r["rec_id"]] = before = at
    return out


def mined_templates(messages: list[str]) -> list[tuple[int, str]]:
    """Cluster number and final template of each message, one after the other as they come."""

    def parameter(token: str) -> bool:
        if re.fullmatch(r"0x[0-9a-fA-F]+|[0-9a-fA-F]{8,}", token):
            return True
        return any(c.isdecimal() for c in token) and all(c.isdecimal() or c in ".:,-+/" for c in token)

    children: dict[tuple, set] = defaultdict(set)
    leaves: dict[tuple, list[int]] = defaultdict(list)
    clusters: list[list[str]] = []
    numbers = []
    for message in messages:
        tokens = message.split() or [""]
        way: tuple = ()
        for key in [str(len(tokens)), *("<*>" if parameter(t) else t for t in tokens[:3])]:
            if key not in children[way]:
                if len(children[way]) >= 100:
                    key = "<*>"
                children[way].add(key)
            way = (*way, key)
        alike = [(sum(a in (b, "<*>") for a, b in zip(clusters[k], tokens)) / len(tokens), -k) for k in leaves[way] if len(clusters[k]) == len(tokens)]
        share, k = max(alike, default=(0.0, 0))
        if alike and share >= 0.4:
            k = -k
            clusters[k] = [a if a == b else "<*>" for a, b in zip(clusters[k], tokens)]
        else:
            k = len(clusters)
            clusters.append(["<*>" if parameter(t) else t for t in tokens])
            leaves[way].append(k)
        numbers.append(k)
    return [(k + 1, " ".join(clusters[k])) for k in numbers]
