"""A thin command line over the pipeline: ``python -m spanloom.cli --tables DIR COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .config import ConfigError, load
from .functions.privacy import Gate, redact_text
from .operators import registry
from .session import local_session

COMMANDS = ("analyze", "ingest", "flush", "summarize", "embed", "bootstrap", "assign", "themes", "report", "delta", "check", "alert", "resolve", "mute", "reopen", "relabel", "export", "publish", "serve", "estimate", "preflight", "redact", "demo", "version")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("args", nargs="*")
    p.add_argument("--tables")
    p.add_argument("--config")
    p.add_argument("--preset")
    p.add_argument("--limit", type=int)
    p.add_argument("--format", default="text")
    p.add_argument("--from", dest="from_window")
    p.add_argument("--to", dest="to_window")
    p.add_argument("--fail-on", default="regression,new")
    p.add_argument("--min-share", type=float, default=0.0)
    p.add_argument("--allow-partial", action="store_true")
    p.add_argument("--no-probe", action="store_true")
    p.add_argument("--out")
    p.add_argument("--port", type=int, default=4318)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        print("spanloom 0.1")
        return 0
    try:
        config = load(a.config, overrides={k: v for k, v in (("table_root", a.tables), ("preset", a.preset)) if v})
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    from .plans import export

    if a.command == "preflight":
        from .plans.readiness import readiness

        known = {}
        if Path(config.table_root).exists():
            from .plans.pipeline import Pipeline

            p = Pipeline(local_session(), config)
            known = {"themes": p.store.table("themes"), "pending": p.pending()}
        found = readiness(config, not a.no_probe, **known)
        print("\n".join(f"{f.level.upper() if f.level == 'fail' else f.level:5}{f.what}: {f.said}" for f in found))
        return int(any(f.level == "fail" for f in found))
    if a.command == "redact":
        text = Path(a.args[0]).read_text() if a.args else sys.stdin.read()
        r = redact_text(text, Gate(config.privacy.mode, config.privacy.scope, config.privacy.salt or ""))
        print(r.text)
        print(json.dumps(dict(sorted(r.counts.items(), key=lambda x: -x[1]))), file=sys.stderr)
        return 0
    if a.command == "serve":
        from .streaming import receiver

        receiver.serve(a.args[0] if a.args else "landing", a.port).serve_forever()
        return 0

    from .plans.pipeline import Pipeline

    spark = local_session()
    p = Pipeline(spark, config)
    show = lambda rows: print(json.dumps(rows, ensure_ascii=False, default=str, indent=2))
    write = lambda said: Path(a.out).write_text(said) if a.out else print(said)
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    try:
        if a.command in ("analyze", "ingest"):
            if a.command == "ingest":
                n, bad = p.ingest(a.args[0])
                print(f"{n} new traces, {bad.count()} rejected lines")
            else:
                show(vars(p.analyze(a.args[0] if a.args else None, a.limit)))
        elif a.command == "demo":
            from .sources.demo import demo_traces

            print(f"{p.store.add('traces', demo_traces(spark, int(a.args[0]) if a.args else 500)[0])} traces")
        elif a.command in ("flush", "embed", "bootstrap"):
            print(getattr(p, a.command)())
        elif a.command == "summarize":
            n, failed = p.summarize(a.limit)
            print(f"{n} traces, {failed.count()} failures")
        elif a.command == "assign":
            show(vars(p.assign()))
        elif a.command == "themes":
            show(rows(p.store.table("themes").drop("centroid").orderBy("id")))
        elif a.command == "report":
            found = rows(p.report())
            show(found) if a.format == "json" else write(export.report_text(found, markdown=a.format == "markdown"))
        elif a.command == "delta":
            found = rows(p.delta(a.from_window, a.to_window))
            show(found) if a.format == "json" else write(export.delta_text(found, a.format == "markdown"))
        elif a.command == "check":
            result = p.check(tuple(a.fail_on.split(",")), a.min_share, a.allow_partial, a.from_window, a.to_window)
            show(result) if a.format == "json" else print(export.check_text(result))
            return int(not result["passed"])
        elif a.command == "alert":
            found = p.alerts()
            error = export.send_alerts(rows(found), config.webhook_url) if config.webhook_url else "no webhook is configured"
            if error:
                print(error, file=sys.stderr)
                return 1
            p.mark_alerted(found)
        elif a.command in ("resolve", "mute", "reopen", "relabel"):
            p.change_theme(getattr(registry, a.command), *a.args)
        elif a.command == "export":
            s = p.store
            kind = "json" if a.format == "text" else a.format
            write(export.render_export(export.export_theme(s.table("traces"), s.table("facet_summaries"), s.table("themes"), s.table("assignments"), a.args[0]), kind))
        elif a.command == "publish":
            write(json.dumps(export.Api(p).snapshot(), ensure_ascii=False, default=str))
        elif a.command == "estimate":
            show(p.estimate())
    except (KeyError, ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
