"""Source files as a table: scan, scope and run order."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no sources.
SKIPPED = ("__pycache__", "venv", "node_modules", ".pytest_cache")
SUFFIXES = (".py", ".ipynb", ".sql")


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: ``**`` is any number of folders, ``*`` and ``?`` stay in one."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.sub(r"([.^$+{}()|\[\]\\])", r"\\\1", pattern[i]), i + 1
    return f"^{out}$"


@dataclass
class Scope:
    """Folders to look in and globs to include and exclude; exclude wins and no include means all."""

    scope_dirs: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str | Path) -> Scope:
        held = json.loads(Path(path).read_text())
        return cls(*(list(held.get(k) or []) for k in ("scope_dirs", "include", "exclude")))

    def merged(self, other: Scope) -> Scope:
        """Both layers, later entries appended, each once."""
        return Scope(*(list(dict.fromkeys([*getattr(self, k), *getattr(other, k)])) for k in ("scope_dirs", "include", "exclude")))

    def matches(self, path: str | Column) -> Column:
        path = F.col(path) if isinstance(path, str) else path
        any_of = lambda globs: F.lit(False) if not globs else path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
        inside = F.lit(True) if not self.scope_dirs else path.rlike("^(?:" + "|".join(re.sub(r"([.^$+{}()|\[\]\\*?])", r"\\\1", s.strip("/")) for s in self.scope_dirs) + ")/")
        return inside & (any_of(self.include) if self.include else F.lit(True)) & ~any_of(self.exclude)


def run_order(path: str | Column) -> Column:
    """Configuration, resources, DDL and SQL, then bronze, silver, gold and the rest; at any depth."""
    path = F.lower(F.col(path) if isinstance(path, str) else path)
    tier = lambda n: path.rlike(rf"(?:^|/){n}/")
    return F.when(tier("(?:config|conf)") | path.rlike(r"(?:^|/)(?:config|settings|constants)\.py$"), 0).when(tier("_resources"), 1).when(tier("ddl") | path.endswith(".sql"), 2).when(tier("bronze"), 3).when(tier("silver"), 4).when(tier("gold"), 5).otherwise(9)


def scan_repository(spark: SparkSession, root: str, scope: Scope | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, warnings): rel_path and content of the sources below a folder, read in parallel; and folders of the scope that are missing."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace("path", f"^.*?{re.escape(base)}/", "")
    named = raw.select(path.alias("rel_path"), F.col("content").cast("string").alias("content"))
    parts = F.split("rel_path", "/")
    kept = named.filter(F.lower("rel_path").rlike(r"\.(?:py|ipynb|sql)$") & ~F.exists(parts, lambda x: x.startswith(".") | x.isin(*SKIPPED)))
    if scope:
        kept = kept.filter(scope.matches("rel_path"))
    missing = [(d, "scope-missing-dir", f"no folder {d}") for d in (scope.scope_dirs if scope else []) if not (Path(base) / d).is_dir()]
    return kept.withColumn("run_order", run_order("rel_path")), spark.createDataFrame(missing, "file string, category string, message string")
