"""Command line: ``python -m gridloom segment | export | debug ...``."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import types
import typing

from gridloom.config import ExportConfig, SegmentConfig
from gridloom.session import build_session


def setup_logging(level: str = "INFO", log_file: str | None = None) -> None:
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if log_file:
        handlers.append(logging.FileHandler(log_file))
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s", handlers=handlers)


def _add_fields(parser: argparse.ArgumentParser, cls) -> None:
    """One option per dataclass field, with its type and default."""
    hints = typing.get_type_hints(cls)
    for f in dataclasses.fields(cls):
        kind = hints[f.name]
        if isinstance(kind, types.UnionType):
            kind = next(t for t in typing.get_args(kind) if t is not type(None))
        option = "--" + f.name.replace("_", "-")
        if kind is bool:
            parser.add_argument(option, action=argparse.BooleanOptionalAction, default=f.default)
        elif typing.get_origin(kind) is tuple:
            item = typing.get_args(kind)[0]
            parser.add_argument(option, type=item, nargs="+", default=f.default)
        else:
            parser.add_argument(option, type=kind, default=f.default)


def _config(cls, args: argparse.Namespace):
    values = {f.name: getattr(args, f.name) for f in dataclasses.fields(cls)}
    return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gridloom")
    commands = parser.add_subparsers(dest="command", required=True)
    _add_fields(commands.add_parser("segment", help="assign points to cells"), SegmentConfig)
    _add_fields(commands.add_parser("train", help="fit the encoder and write its weights"), SegmentConfig)
    export = commands.add_parser("export", help="write matrix, points and outlines of a segmentation")
    _add_fields(export, ExportConfig)
    export.add_argument("--platform", default=None)
    again = commands.add_parser("segment-only", help="re-run thresholds from written predictions")
    for name in ("cells", "predictions", "output-directory"):
        again.add_argument(f"--{name}", required=True)
    rescore = commands.add_parser("predict-only", help="re-run scoring from written embeddings")
    for name in ("points", "candidates", "tx", "bd", "cells", "output-directory"):
        rescore.add_argument(f"--{name}", required=True)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = build_parser().parse_args(argv)
    setup_logging()
    from gridloom.plans import export as export_plan
    from gridloom.plans import segment as segment_plan

    spark = build_session()
    if args.command == "segment":
        segment_plan.segment(spark, _config(SegmentConfig, args))
    elif args.command == "train":
        segment_plan.train_only(spark, _config(SegmentConfig, args))
    elif args.command == "export":
        export_plan.export(spark, _config(ExportConfig, args), args.platform)
    elif args.command == "segment-only":
        segment_plan.segment_only(spark, args.cells, args.predictions, args.output_directory)
    else:
        segment_plan.predict_only(
            spark, args.points, args.candidates, args.tx, args.bd, args.cells, args.output_directory
        )
