"""python -m millrace run|validate|gen-data|workloads|transformations|serve"""

from __future__ import annotations

import argparse
import sys

from millrace import workloads
from millrace.plans.errors import ValidationError, WorkflowError
from millrace.plans.validate import parse_and_validate
from millrace.telemetry import Telemetry


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("run", "validate"):
        p = sub.add_parser(name)
        p.add_argument("--file", required=True)
    sub.choices["run"].add_argument("--eager", action="store_true", help="compute every node, also those that no sink reads")
    p = sub.add_parser("gen-data")
    p.add_argument("--rows", type=int, default=1000)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--out-dir", default="data")
    for name in ("workloads", "transformations"):
        p = sub.add_parser(name)
        p.add_argument("--rows", type=int, default=1000)
        p.add_argument("--seed", type=int, default=42)
        p.add_argument("--out-dir", default="data")
        p.add_argument("--telemetry-format", default="text")
        p.add_argument("--telemetry-level", default="basic")
    p = sub.add_parser("serve")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8080)
    p.add_argument("--database", default="millrace.db")
    p.add_argument("--objects", default="objects")
    return top


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "serve":
        from millrace.api import server
        from millrace.registry import Registry

        server(Registry(args.database, args.objects), args.host, args.port).serve_forever()
        return 0
    if args.command in ("run", "validate"):
        try:
            with open(args.file, encoding="utf-8") as f:
                spec = parse_and_validate(f.read())
        except (OSError, ValidationError) as e:
            print(e, file=sys.stderr)
            return 1
        if args.command == "validate":
            print(f"VALID pipeline_id={spec.pipeline_id} version={spec.version} nodes={len(spec.nodes)} sinks={len(spec.sinks)}")
            return 0
    from millrace.plans.runner import run
    from millrace.session import session
    from millrace.sources.people import generate

    spark = session()
    if args.command == "run":
        try:
            for r in run(spark, spec, eager=args.eager):
                print(f"SINK node_id={r.node_id} target_table={r.target_table} rows={r.rows}" + (f" target_path={r.target_path}" if r.target_path else ""))
        except WorkflowError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    paths = generate(spark, args.rows, args.seed, args.out_dir)
    if args.command == "gen-data":
        print("\n".join(paths))
        return 0
    told = Telemetry(args.telemetry_format, args.telemetry_level)
    return 0 if workloads.run(spark, workloads.SOURCES if args.command == "workloads" else workloads.TRANSFORMATIONS, args.out_dir, told) else 1


if __name__ == "__main__":
    sys.exit(main())
