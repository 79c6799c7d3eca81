"""Source files of a working tree as a snapshot table."""

from __future__ import annotations

import errno
import os
import stat
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

# Folders that hold no sources of their own.
SKIPPED = ".git .hg .svn .venv venv env __pycache__ .tox .nox .mypy_cache .pytest_cache .ruff_cache node_modules build dist .eggs site-packages .idea .vscode .claude .worktrees".split()
_SAFE_GIT = ["git", "-c", "core.fsmonitor=false", "-c", "core.hooksPath=/dev/null"]


def tracked_files(root: str, timeout: int = 30) -> list[str] | None:
    """Paths of the tracked Python files; None where git has none to give."""
    if not (Path(root) / ".git").exists():
        return None
    try:
        out = subprocess.run([*_SAFE_GIT, "-C", root, "ls-files", "-z", "--", "*.py"], capture_output=True, timeout=timeout, env={"PATH": "/usr/bin:/bin", "GIT_CONFIG_NOSYSTEM": "1"})
    except (OSError, subprocess.TimeoutExpired):
        return None
    names = sorted(n.decode("utf-8", "surrogateescape") for n in out.stdout.split(b"\0") if n)
    return names or None if out.returncode == 0 else None


def read_tree(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """(repo_id, path, state, bytes, mtime_ns, size_bytes): tracked files, or else all below ``root`` outside skipped folders.

    Contents are read by the executors.
    """
    base = Path(root).resolve().as_uri()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(str(Path(root).resolve()))
    rows = found.select(F.expr(f"substr(path, {len(base.replace('file://', 'file:')) + 2})").alias("path"), F.lit("present").alias("state"), F.col("content").alias("bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size_bytes"))
    tracked = tracked_files(root)
    if tracked is not None:
        rows = rows.join(spark.createDataFrame([(p,) for p in tracked], "path string"), "path", "left_semi")
    else:
        parts = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
        rows = rows.filter(~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED))))
    return rows.select(F.lit(repo_id).alias("repo_id"), "path", "state", "bytes", "mtime_ns", "size_bytes")


# Fixed value: the largest file that evidence is read from.
MAX_BYTES = 2_000_000


class ReadRefused(ValueError):
    """Why a file is not read: path_escapes_repo, file_missing, file_not_regular or file_too_large."""


def read_rooted(root: str, path: str, limit: int = MAX_BYTES) -> bytes:
    """The bytes of a regular file below ``root``; no component may be a link, and none leads out."""
    parts = path.replace("\\", "/").split("/")
    if not path or "\0" in path or path.startswith("/") or any(p == ".." for p in parts):
        raise ReadRefused("path_escapes_repo")
    parts = [p for p in parts if p not in ("", ".")]
    if not parts:
        raise ReadRefused("file_not_regular")
    at = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    try:
        for i, part in enumerate(parts):
            flags = os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK | (os.O_DIRECTORY if i < len(parts) - 1 else 0)
            try:
                nxt = os.open(part, flags, dir_fd=at)
            except FileNotFoundError:
                raise ReadRefused("file_missing") from None
            except OSError as e:
                raise ReadRefused("path_escapes_repo" if e.errno in (errno.ELOOP, errno.ENOTDIR) and os.path.islink(os.path.join(root, *parts[: i + 1])) else "file_not_regular") from None
            os.close(at)
            at = nxt
        about = os.fstat(at)
        if not stat.S_ISREG(about.st_mode):
            raise ReadRefused("file_not_regular")
        if about.st_size > limit:
            raise ReadRefused("file_too_large")
        with os.fdopen(at, "rb", closefd=False) as f:
            data = f.read(limit + 1)
        if len(data) > limit:
            raise ReadRefused("file_too_large")
        return data
    finally:
        os.close(at)


def commits(spark: SparkSession, root: str, timeout: int = 120) -> DataFrame:
    """(sha, subject, body, files) of a repository's changes, merges left out; no rows where git has none."""
    form = "--format=%x01%H%x02%s%x02%b%x02"
    out = subprocess.run([*_SAFE_GIT, "-C", root, "log", "--no-merges", "--name-only", form], capture_output=True, timeout=timeout, env={"PATH": "/usr/bin:/bin", "GIT_CONFIG_NOSYSTEM": "1"})
    rows = []
    for entry in out.stdout.decode("utf-8", "replace").split("\x01")[1:] if out.returncode == 0 else ():
        sha, subject, body, names = entry.split("\x02", 3)
        rows.append((sha, subject, body.strip(), [n for n in names.split("\n") if n]))
    return spark.createDataFrame(rows, "sha string, subject string, body string, files array<string>")
