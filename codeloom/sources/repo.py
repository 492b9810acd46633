"""A source tree as a table: the data source 'repo' walks a folder with its ignore rules, hidden files included.

spark.dataSource.register(RepoSource); spark.read.format("repo").load(folder). The folder must be one that all executors
see. Top-level folders are read as partitions of their own; the ignore rules are applied while walking, so that ignored
folders are never entered. Option dir limits the walk to a folder below."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from codeloom.schema import FILES, LANGUAGE_OF

#: Folders that are never entered; folders that are not entered where there are no ignore rules.
ALWAYS = {".git", ".codeloom", ".claude"}
DEFAULT_IGNORED = {"node_modules", "vendor", "__pycache__", ".venv", "venv", "target", "build", "dist", ".next", ".idea", ".vscode", "bin", "obj"}
LARGEST, SNIFFED = 1 << 20, 512


def always_ignored(path: str) -> bool:
    return not ALWAYS.isdisjoint(path.split("/"))


def is_binary(head: bytes) -> bool:
    return b"\0" in head[:SNIFFED]


class Rule:
    """One line of an ignore file."""

    def __init__(self, line: str):
        self.negated = line.startswith("!")
        body = line[self.negated :]
        self.dir_only = body.endswith("/")
        body = body.rstrip("/")
        self.anchored = "/" in body
        body = body.lstrip("/")
        out, i = "", 0
        while i < len(body):
            if body.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif body.startswith("**", i):
                out, i = out + ".*", i + 2
            elif body[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif body[i] == "?":
                out, i = out + "[^/]", i + 1
            else:
                out, i = out + re.escape(body[i]), i + 1
        self.regex = re.compile(out if self.anchored else f"(?:.*/)?{out}")

    def matches(self, path: str, is_dir: bool) -> bool:
        return (is_dir or not self.dir_only) and self.regex.fullmatch(path) is not None


def load_rules(root: str) -> list[Rule] | None:
    """The rules of root's ignore file, None without one."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
            return [Rule(x) for x in map(str.strip, f) if x and not x.startswith("#")]
    except OSError:
        return None


def ignored(rules: list[Rule] | None, path: str, is_dir: bool) -> bool:
    """The last matching rule decides."""
    out = False
    for r in rules or ():
        if r.matches(path, is_dir):
            out = not r.negated
    return out


def ignored_paths(paths: DataFrame, lines: list[str]) -> DataFrame:
    """paths(path) with ignored: whether a folder above the path, or the path itself, is what the last matching rule ignores."""
    rules = [Rule(x) for x in lines]

    def verdict(path: Column, is_dir: bool) -> Column:
        out = F.lit(False)
        for r in rules:
            if is_dir or not r.dir_only:
                out = F.when(F.regexp_like(path, F.lit(f"^(?:{r.regex.pattern})$")), F.lit(not r.negated)).otherwise(out)
        return out

    parts = F.split("path", "/")
    folders = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))
    return paths.withColumn("ignored", F.exists(folders, lambda f: verdict(f, True)) | verdict(F.col("path"), False))


def skip_dir(rules: list[Rule] | None, root: str, path: str) -> bool:
    name = os.path.basename(path)
    if name in ALWAYS or os.path.exists(os.path.join(root, path, ".git")):
        return True
    return ignored(rules, path, True) if rules is not None else name in DEFAULT_IGNORED


def walk(root: str, start: str = "", deep: bool = True) -> Iterator[str]:
    """Paths of files below root/start, relative to root, in order."""
    rules, stack = load_rules(root), [start]
    while stack:
        here = stack.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, here)), key=lambda e: e.name, reverse=True)
        except OSError:
            continue
        for e in entries:
            path = f"{here}/{e.name}" if here else e.name
            if e.is_dir(follow_symlinks=False):
                if deep and not skip_dir(rules, root, path):
                    stack.append(path)
            elif e.is_file() and not ignored(rules, path, False) and e.stat().st_size <= LARGEST:
                yield path


def record(root: str, path: str) -> tuple | None:
    """(path, mtime_ns, size, content, lang) of a text file, None for binary and vanished ones."""
    full = os.path.join(root, path)
    try:
        st = os.stat(full)
        with open(full, "rb") as f:
            data = f.read()
    except OSError:
        return None
    if is_binary(data):
        return None
    return path, st.st_mtime_ns, len(data), data, LANGUAGE_OF.get(os.path.splitext(path)[1].lower())


class _Part(InputPartition):
    def __init__(self, start: str, deep: bool):
        self.start, self.deep = start, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str, start: str):
        self.root, self.start = root, start

    def partitions(self):
        rules = load_rules(self.root)
        top = os.path.join(self.root, self.start)
        dirs = sorted(e.name for e in os.scandir(top) if e.is_dir(follow_symlinks=False))
        paths = [f"{self.start}/{d}" if self.start else d for d in dirs]
        return [_Part(self.start, False), *(_Part(p, True) for p in paths if not skip_dir(rules, self.root, p))]

    def read(self, partition):
        for path in walk(self.root, partition.start, partition.deep):
            if (row := record(self.root, path)) is not None:
                yield row


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class _Writer(DataSourceWriter):
    """Writes each file beside its place and then moves it there; a failed job takes its own files away and leaves older ones as they were."""

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator):
        paths = []
        for row in iterator:
            full = os.path.normpath(os.path.join(self.root, row["path"]))
            if not full.startswith(os.path.normpath(self.root) + os.sep):
                raise ValueError(f"{row['path']} lies outside the tree")
            os.makedirs(os.path.dirname(full), exist_ok=True)
            held = f"{full}.{uuid.uuid4().hex}.part"
            with open(held, "wb") as f:
                f.write(bytes(row["content"]))
            paths.append((held, full))
        return _Written(paths)

    def commit(self, messages):
        for m in messages:
            for held, full in m.paths if m else ():
                os.replace(held, full)

    def abort(self, messages):
        for m in messages:
            for held, _ in m.paths if m else ():
                if os.path.exists(held):
                    os.remove(held)


class RepoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("dir", "").strip("/"))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_repo(files: DataFrame, root: str) -> None:
    """Write files(path, content text or bytes) below root, a folder that all machines share: all of them, or on failure none."""
    files.sparkSession.dataSource.register(RepoSource)
    files.select("path", F.col("content").cast("binary").alias("content")).write.format("repo").mode("append").save(root)


def read_repo(spark: SparkSession, root: str, directory: str = "") -> DataFrame:
    spark.dataSource.register(RepoSource)
    return spark.read.format("repo").option("dir", directory).load(root)
