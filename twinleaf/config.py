"""The configuration folder: default files, ignore rules and logging."""

from __future__ import annotations

import configparser
import logging
import os
import sys
from collections.abc import Sequence

from .sources.scan import IgnoreRules

LOG = logging.getLogger(__name__)
IGNORE_FILE = ".ignore"
#: What a new configuration folder holds.
DEFAULTS = {"config.ini": "[override]\nignore-file = .ignore\n", IGNORE_FILE: "# rules in the manner of .gitignore, counted from the folder that is scanned\n"}
FORMAT = "%(asctime)s [%(levelname)s] %(name)s - %(message)s"


def conf_dir() -> str:
    """TWINLEAF_CONFIG_DIR, or .twinleaf in the home folder."""
    return os.environ.get("TWINLEAF_CONFIG_DIR") or os.path.join(os.path.expanduser("~"), ".twinleaf")


def bootstrap(folder: str) -> str:
    """Makes the folder and the default files that it lacks; returns it."""
    os.makedirs(folder, exist_ok=True)
    for name, text in DEFAULTS.items():
        if not os.path.exists(at := os.path.join(folder, name)):
            with open(at, "w", encoding="utf-8") as f:
                f.write(text)
    return folder


def set_up_logging(folder: str, level: int = logging.INFO) -> logging.Logger:
    """Messages of this package from level on go to stderr and to a file in the folder."""
    logger = logging.getLogger("twinleaf")
    logger.setLevel(level)
    for h in list(logger.handlers):
        logger.removeHandler(h)
        h.close()
    for h in (logging.StreamHandler(sys.stderr), logging.FileHandler(os.path.join(folder, "twinleaf.log"), encoding="utf-8")):
        h.setFormatter(logging.Formatter(FORMAT))
        logger.addHandler(h)
    return logger


class Config:
    """Settings of config.ini in a folder; a missing file or section leaves the defaults."""

    def __init__(self, folder: str | None = None) -> None:
        self.folder = folder or conf_dir()
        self._ini = configparser.ConfigParser()
        self._ini.read(os.path.join(self.folder, "config.ini"), encoding="utf-8")

    def ignore_file(self) -> str:
        return self._ini.get("override", "ignore-file", fallback=IGNORE_FILE)


def load_ignore(path: str, anchor: str) -> IgnoreRules | None:
    """The rules of a file; None, with a warning, if it is missing or no UTF-8."""
    try:
        with open(path, encoding="utf-8") as f:
            return IgnoreRules(f.readlines(), anchor)
    except FileNotFoundError:
        LOG.warning("no ignore file at %s", path)
    except UnicodeDecodeError as e:
        LOG.warning("the ignore file at %s is not valid UTF-8: %s", path, e)
    return None


def anchor_of(roots: Sequence[str]) -> str:
    """The folder that ignore rules count from: what the roots have in common, or the working folder."""
    try:
        common = os.path.commonpath(roots)
    except ValueError:
        return os.getcwd()
    return os.path.dirname(common) if os.path.isfile(common) else common


def find_ignore(config: Config, anchor: str) -> IgnoreRules | None:
    """The rules of the file that the configuration names, else those of the default file, else None."""
    named, default = (os.path.join(config.folder, x) for x in (config.ignore_file(), IGNORE_FILE))
    found = load_ignore(named, anchor)
    return found if found is not None or named == default else load_ignore(default, anchor)
