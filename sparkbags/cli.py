"""Command line: run an application given as ``module:Class``."""

from __future__ import annotations

import argparse
import importlib

from .plans.app import AppConf
from .session import get_session, ship


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="sparkbags")
    p.add_argument("app")
    p.add_argument("--root", required=True, help="folder of the bags, on storage all machines share")
    p.add_argument("--file", default="")
    p.add_argument("--size", type=int, default=1 << 30)
    p.add_argument("--text-mode", action="store_true")
    p.add_argument("-G", action="append", default=[], metavar="KEY=VALUE")
    p.add_argument("-H", action="append", default=[], metavar="KEY=VALUE")
    p.add_argument("--restart-phase", type=int, default=0)
    p.add_argument("--simulation", type=int, default=0)
    p.add_argument("--describe", action="store_true")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = parse(argv)
    module, _, name = a.app.partition(":")
    pairs = lambda xs: dict(x.partition("=")[::2] for x in xs)
    app = getattr(importlib.import_module(module), name)(ship(get_session(name)), a.root, AppConf(a.file, a.size, a.text_mode, pairs(a.G), pairs(a.H), a.simulation))
    if a.describe:
        print(app.describe())
    else:
        for i, s in app.run(a.restart_phase).timings:
            print(f"phase {i}: {s:.2f} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
