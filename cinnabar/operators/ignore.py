"""Which paths a scan leaves out: test files, patterns of gitignore files, default and own patterns.

Patterns are shell patterns (* crosses slashes); one that ends in a slash names a folder.  Paths are relative to the root.
A pattern that starts with ! never takes a path back, as it is looked at only where nothing matched.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinnabar.functions.text import is_test_path

_FOLDERS = """
.bzr .conda .env .git .hg .idea .mypy_cache .pytest_cache .ruff_cache .sphinx .svn .temp .tmp .tox .venv .vscode ENV
/Library/Python/* /opt/python* /usr/lib/python* /usr/local/lib/python* *.dist-info *.egg-info .local/lib/python*/site-packages
__pycache__ _build anaconda* bower_components build dist docs/_build docs/build env env.bak envs htmlcov
lib/python*/site-packages miniconda* node_modules site-packages temp tmp venv venv.bak
""".split()
_FILES = """
*.db *.log *.pyc *.pyd *.pyo *.so *.sqlite *.sqlite3 *.swo *.swp *.tmp */site-packages/* *~ .DS_Store .coverage .env .env.*
.gitignore .gitmodules Thumbs.db __init__.py config.local.* secrets.*
""".split()
DEFAULTS = frozenset([f"{x}/" for x in _FOLDERS] + _FILES)


def shell_regex(pattern: str) -> str:
    """A shell pattern as a regular expression of Java, over the whole text."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        close = pattern.find("]", k + 2 + pattern.startswith("!", k + 1)) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inner = pattern[k + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += f"[{'^' + inner[1:] if inner.startswith('!') else inner}]"
            k = close
        else:
            out += c if c.isalnum() or c in "_/" or ord(c) > 127 else "\\" + c
        k += 1
    return out


def _part(pattern: str) -> str:
    """A whole part of a path that fits the pattern."""
    return f"(?:^|.*/){shell_regex(pattern).replace('.*', '[^/]*')}(?:/.*)?"


def path_regex(pattern: str) -> str:
    """What a default or own pattern leaves out, as one regular expression over the whole path."""
    if pattern.endswith("/"):
        folder = pattern.rstrip("/")
        ways = ["\\Q" + folder + "\\E(?:/.*)?", shell_regex(folder + "/*")] + [_part(folder)] * ("/" not in folder)
    else:
        ways = [shell_regex(pattern), _part(pattern)] if "/" not in pattern else [shell_regex(pattern)]
    return "|".join(ways)


def gitignore_regex(pattern: str) -> str:
    """The same of a pattern from a gitignore file, where a folder matches from the root only."""
    if pattern.endswith("/"):
        folder = pattern.rstrip("/")
        return "\\Q" + folder + "\\E(?:/.*)?|" + shell_regex(folder + "/*")
    return "|".join([shell_regex(pattern)] + [_part(pattern)] * ("/" not in pattern))


def is_ignored(path: Column, patterns: frozenset[str] | set[str] | list[str] = DEFAULTS, gitignore: set[str] | list[str] = (), tests: bool = True) -> Column:
    """Whether a path is left out; tests: test files are."""
    every = [path_regex(p) for p in sorted(patterns) if not p.startswith("!")] + [gitignore_regex(p) for p in sorted(gitignore)]
    hit = path.rlike(f"(?s)^(?:{'|'.join(every)})$") if every else F.lit(False)
    return hit | is_test_path(path) if tests else hit


def _lines(file: Path) -> list[str]:
    """The lines of a pattern file that aren't blank or comments."""
    return [x for x in (line.strip() for line in file.read_text(encoding="utf-8").splitlines()) if x and not x.startswith("#")]


class Ignore:
    """Patterns of a project: the defaults, those of its ignore file, and of gitignore files from its root upwards."""

    def __init__(self, root: str | Path, file: str = ".cinnabarignore", gitignore: bool = True, include_tests: bool = False) -> None:
        self.root, self.include_tests = Path(root).resolve(), include_tests
        self.file = self.root / file
        self.patterns = set(DEFAULTS) | set(_lines(self.file) if self.file.exists() else [])
        self.gitignore: set[str] = set()
        # files above the root are looked at and their patterns left out, as these name paths outside of it
        if gitignore and (self.root / ".gitignore").exists():
            self.gitignore = {p for p in _lines(self.root / ".gitignore") if not p.startswith("!")}

    def add(self, pattern: str) -> None:
        self.patterns.add(pattern)

    def remove(self, pattern: str) -> None:
        self.patterns.discard(pattern)

    def listed(self) -> list[tuple[str, str]]:
        """(pattern, where it comes from), in order."""
        own = [(p, "default" if p in DEFAULTS else "custom") for p in sorted(self.patterns)]
        return own + [(p, "gitignore") for p in sorted(self.gitignore)]

    def save(self) -> None:
        """Own patterns to the ignore file, which goes where there are none."""
        own = sorted(self.patterns - DEFAULTS)
        if own:
            self.file.write_text("# patterns of paths to leave out\n" + "\n".join(own) + "\n", encoding="utf-8")
        elif self.file.exists():
            self.file.unlink()

    def ignored(self, path: Column) -> Column:
        return is_ignored(path, self.patterns, self.gitignore, tests=not self.include_tests)
