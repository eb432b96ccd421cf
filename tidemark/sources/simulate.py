"""Small made-up log bundles for tests and trials: a zip of logs in several layouts, and what is true of them."""

from __future__ import annotations

import io
import json
import random
import zipfile
from datetime import datetime, timedelta, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTS = ["queue", "ledger", "mirror", "sector", "socket", "digest", "cache"]
ACTS = ["opened", "closed late", "retry failed", "settled", "timed out"]
LEVELS = ["DEBUG", "INFO", "INFO", "INFO", "WARN", "ERROR"]


def render(layout: str, at: datetime, level: str, name: str, message: str, uptime: float) -> str:
    if layout == "bracket":
        return f"{at:%Y-%m-%d %H:%M:%S}.{at.microsecond // 1000:03d} [{name}] {level} {message}"
    if layout == "logcat":
        return f"{at:%m-%d %H:%M:%S}.{at.microsecond // 1000:03d}  1200  1300 {level[0]} {name}: {message}"
    if layout == "json":
        return json.dumps({"ts": at.isoformat(timespec="milliseconds") + "+08:00", "lvl": level, "module": name, "msg": message})
    if layout == "kernel":
        return f"[{uptime:12.6f}] <{ {'ERROR': 3, 'WARN': 4, 'INFO': 6}.get(level, 7)}>{message}"
    if layout == "chinese":
        return f"{at:%Y-%m-%d %H:%M:%S} 【{ {'ERROR': '错误', 'WARN': '警告', 'DEBUG': '调试'}.get(level, '信息')}】存储 {message}"
    return f"ts={at.isoformat()}+08:00 level={level.lower()} comp={name} {message}"


#: path below logs/, layout, encoding
FILES = [
    ("ota_master/ota_master.log", "bracket", "utf-8"),
    ("ota_master/ota_master.log.1", "bracket", "utf-8"),
    ("tbox/tbox_comm.log", "logcat", "utf-8"),
    ("verify/verify.jsonl", "json", "utf-8"),
    ("kernel/dmesg.log", "kernel", "utf-8"),
    ("storage/storage_svc.log", "chinese", "gb18030"),
    ("campaign/campaign.log", "kv", "utf-8"),
]


def bundle(seed: int, lines: int = 60) -> tuple[bytes, dict]:
    """The archive's bytes, and its truth: records by file, lines with a stack, the alias."""
    rnd = random.Random(seed)
    start = datetime(2025, 3, 1, 8, 0, 0) + timedelta(days=seed)
    out, truth = io.BytesIO(), {"records": {}, "stacks": 0, "seed": seed}
    vin = f"XVT{seed:014d}"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

        def put(name: str, data: bytes) -> None:
            info = zipfile.ZipInfo(name, (2025, 3, min(28, 2 + seed), 9, 0, 0))
            z.writestr(info, data, zipfile.ZIP_DEFLATED)

        meta = {"task_id": f"T-{seed}", "campaign_id": "CMP-1", "vin": vin, "model": "M", "region": "CN", "timezone": "Asia/Shanghai"}
        put("package_meta.json", json.dumps(meta | {"collected_at": (start + timedelta(hours=3)).replace(tzinfo=timezone.utc).isoformat()}).encode())
        for path, layout, encoding in FILES:
            at, rows = start, []
            for i in range(lines):
                at += timedelta(milliseconds=rnd.randint(5, 4000))
                level = rnd.choice(LEVELS)
                message = f"{rnd.choice(PARTS)} {rnd.choice(ACTS)} size={rnd.randint(1, 99999)} ecu=0x7{rnd.randint(10, 99)}"
                rows.append(render(layout, at, level, path.split("/")[0], message, (at - start).total_seconds()))
                if level == "ERROR" and layout != "json" and rnd.random() < 0.3:
                    rows.append("    at com.example.Worker.step(Worker.java:12)")
                    truth["stacks"] += 1
            truth["records"][f"logs/{path}"] = lines
            put(f"logs/{path}", ("\n".join(rows) + "\n").encode(encoding))
            if path.startswith("kernel"):
                put("logs/kernel/dmesg_copy.log", ("\n".join(rows) + "\n").encode(encoding))
        put("logs/core.bin", bytes(range(32)) * 50)
    return out.getvalue(), truth


class BundleSource(DataSource):
    """`spark.read.format("made_up_bundles").option("bundles", n)`: name, content of n archives."""

    @classmethod
    def name(cls) -> str:
        return "made_up_bundles"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(int(self.options.get("bundles", 1)), int(self.options.get("lines", 60)))


class _Reader(DataSourceReader):
    def __init__(self, bundles: int, lines: int):
        self.bundles, self.lines = bundles, lines

    def partitions(self):
        return [InputPartition(i) for i in range(self.bundles)]

    def read(self, partition):
        yield f"bundle-{partition.value}.zip", bundle(partition.value, self.lines)[0]
