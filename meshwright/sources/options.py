"""Load options and their command-line form."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class LoadOptions:
    """How edge files are read.

    ``lenient`` takes the numeric prefix of a token, 0 without one; otherwise a
    line whose ids or weight aren't numbers is rejected.  An empty ``comment``
    means that there are no comments, an empty ``file_ext`` that any file will do.
    """

    directed: bool = False
    keep_self_loops: bool = False
    keep_duplicates: bool = False
    reorder: bool = False
    base_1: bool = False
    weighted: bool = True
    string_ids: bool = False
    lenient: bool = False
    file_ext: str = ""
    comment: str = "%"
    separators: str = " \t"


@dataclass(frozen=True)
class VertexOptions:
    """How vertex files are read."""

    file_ext: str = ""
    comment: str = "%"
    separators: str = " \t"
    base_1: bool = False


def argument_parser(**extra: tuple[type, object]) -> argparse.ArgumentParser:
    """The common options of all programs; ``extra`` adds name=(type, default)."""
    p = argparse.ArgumentParser(add_help=True)
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output")
    p.add_argument("-r", "--reorder", action="store_true")
    p.add_argument("-d", "--directed", action="store_true")
    p.add_argument("--file_ext", default="")
    p.add_argument("--comment_prefix", dest="comment", default="%")
    p.add_argument("--line_sep", dest="separators", default=" \t")
    p.add_argument("--keep_self", dest="keep_self_loops", action="store_true")
    p.add_argument("--keep_dup", dest="keep_duplicates", action="store_true")
    for name, (kind, default) in extra.items():
        p.add_argument(f"--{name}", type=kind, default=default)
    return p


def from_arguments(args: argparse.Namespace) -> LoadOptions:
    known = {f.name for f in fields(LoadOptions)}
    return LoadOptions(**{k: v for k, v in vars(args).items() if k in known})
