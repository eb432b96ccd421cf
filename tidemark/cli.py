"""python -m tidemark.cli build ARCHIVES WORKSPACE | query WORKSPACE TOOL [JSON] | verify WORKSPACE PACK | doctor"""

from __future__ import annotations

import argparse
import json
import os
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("build")
    p.add_argument("archives")
    p.add_argument("workspace")
    p.add_argument("--run-id", default="R0")
    p.add_argument("--rules", help="JSON or YAML of parsers, phases and components")
    p = sub.add_parser("query")
    p.add_argument("workspace")
    p.add_argument("tool")
    p.add_argument("args", nargs="?", default="{}")
    p = sub.add_parser("verify")
    p.add_argument("workspace")
    p.add_argument("pack", help="an evidence pack as JSON")
    sub.add_parser("doctor")
    a = parser.parse_args(argv)
    from tidemark.session import local_session

    spark = local_session()
    if a.command == "doctor":
        print(json.dumps({"spark": spark.version, "python": sys.version.split()[0], "cores": spark.sparkContext.defaultParallelism}))
        return 0
    if a.command == "build":
        from tidemark.operators.build import build, write_manifest
        from tidemark.rules import Rules, load_rules

        os.makedirs(a.workspace, exist_ok=True)
        result = build(spark, a.archives, a.workspace, a.run_id, rules=load_rules(a.rules) if a.rules else Rules())
        write_manifest(result, f"{a.workspace}/manifest.json")
        print(json.dumps(result, default=str))
        return 0 if all(result["checks"].values()) else 1
    if a.command == "verify":
        from tidemark.operators.evidence import verify_l0, verify_l1

        with open(a.pack, encoding="utf-8") as f:
            pack = json.load(f)
        items = spark.createDataFrame([(i["row_hash"], i["raw_hash"]) for i in pack["items"]], "row_hash string, raw_hash string")
        found = {r.row_hash: r.status for r in verify_l1(items, spark.read.parquet(f"{a.workspace}/log_lines")).collect()}
        print(json.dumps({"pack": verify_l0(pack), "items": found}))
        return 0 if verify_l0(pack) and set(found.values()) <= {"OK"} else 1
    from tidemark.operators.tools import LogStore

    tables = {n: spark.read.parquet(f"{a.workspace}/{n}") for n in ("log_lines", "files", "templates", "runs", "parse_errors") if os.path.exists(f"{a.workspace}/{n}")}
    out = LogStore(spark, tables).call(a.tool, **json.loads(a.args))
    print(json.dumps(out.__dict__, ensure_ascii=False, default=str))
    return 0 if out.ok else 2


if __name__ == "__main__":
    sys.exit(main())
