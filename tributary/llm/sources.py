"""Problem 4: source files that do not parse, by packrat grammars.

Each file is parsed by the grammar of its extension and must be consumed whole. For one that is not, the
furthest position reached is reported with its cause: a conflict marker on that line, the end of the file
(truncated), text that another grammar takes whole (wrong extension), or what the tokenizer met.

Defined results: extensions count in any case; files of other extensions are not judged (``valid`` is
null); a null content counts as empty, which is a valid Python or SQL file and no JSON text; rows with a
null file id are left out; a Python or SQL text nested too deep to parse is invalid, as it is for the language's
own parser, and JSON may nest to any depth. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import latest_version
from ..queries.tables import table
from . import grammar_json, grammar_python, grammar_sql, peg

EXTENSIONS = {"py": "python", "sql": "sql", "ipynb": "notebook", "json": "json"}
_MARKER = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?:\s|$)")


@lru_cache(maxsize=None)
def _parser(language: str):
    """(tokens, parse) of a language, compiled once a process."""
    if language == "python":
        return grammar_python.tokens, peg.compiled(grammar_python.GRAMMAR, "file")
    if language == "sql":
        return grammar_sql.tokens, peg.compiled(grammar_sql.grammar(), "script")
    return grammar_json.tokens, peg.compiled(grammar_json.GRAMMAR, "text")


def _depth(kinds: list[str]) -> int:
    """How deep brackets nest."""
    depth = deepest = 0
    for kind in kinds:
        if kind in "[{":
            depth += 1
            deepest = max(deepest, depth)
        elif kind in "]}":
            depth -= 1
    return deepest


def furthest_failure(text: str, language: str) -> tuple[int, str] | None:
    """None for a text that parses whole, else the offset of the furthest failure and its lexical cause."""
    tokens, parse = _parser(language)
    kinds, at, cause = tokens(text)
    # JSON may nest to any depth; the other languages' own parsers give up earlier than this
    room = 20_000 + (8 * _depth(kinds) if language == "json" else 0)
    if sys.getrecursionlimit() < room:
        sys.setrecursionlimit(room)
    try:
        failed = parse(kinds)
    except RecursionError:
        return 0, "nesting"
    if failed is None:
        return None
    failed = min(failed, len(at) - 1)
    return at[failed], cause if kinds[failed] == "BAD" else "end of file" if kinds[failed] == "EOF" else ""


def diagnosed(text: str | None, language: str) -> tuple[bool, int | None, int | None, str | None]:
    """(valid, line, column, cause), line and column from 1."""
    text = text or ""
    failure = furthest_failure(text, language)
    if failure is None:
        return True, None, None, None
    offset, cause = failure
    before = text[:offset]
    breaks = [m.end() for m in re.finditer(r"\r\n|\r|\n", before)]
    start = breaks[-1] if breaks else 0
    line = re.split(r"[\r\n]", text[start : start + 200], maxsplit=1)[0]
    if _MARKER.match(line) or (_MARKER.search(text) and re.search(r"^(?:<{7}|>{7})\s", text, re.M)):
        cause = "conflict marker"
    elif not text.strip():
        cause = "empty"
    else:
        other = next((o for o in ("python", "sql", "json") if o != language and not (o == "json" and language == "notebook") and text.strip() and furthest_failure(text, o) is None), None)
        cause = f"wrong extension: {other}" if other else cause or "syntax"
    return False, len(breaks) + 1, offset - start + 1, cause


def judged(files: DataFrame, causes: bool = True) -> DataFrame:
    """(file_id, repo, language, valid, line, column, cause) of every file; without ``causes`` the last three are null and no other grammar is tried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("rel_path").to_pylist(), batch.column("content").to_pylist()):
                language = EXTENSIONS.get((path or "").rpartition(".")[2].strip().lower())
                if language is None:
                    rows.append((None,) * 5)
                elif causes:
                    rows.append((language, *diagnosed(content, "json" if language == "notebook" else language)))
                else:
                    rows.append((language, furthest_failure(content or "", "json" if language == "notebook" else language) is None, None, None, None))
            kinds = (pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("repo"), *columns], names=["file_id", "repo", "language", "valid", "line", "column", "cause"])

    cut = files.filter("file_id is not null").select(F.col("file_id").cast("bigint").alias("file_id"), "repo", "rel_path", "content")
    return cut.mapInArrow(run, "file_id bigint, repo string, language string, valid boolean, line int, column int, cause string")


def _files(spark: SparkSession, sf_dir: str, causes: bool = True) -> DataFrame:
    return judged(latest_version(table(spark, sf_dir, "source_files").select("file_id", "repo", "rel_path", "content", "ingested_ts"), "file_id"), causes)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, causes=False).filter("not valid").select("file_id")


def p4_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).filter("not valid").drop("valid")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and failures by repository and language, with subtotals (null) of each and of all."""
    bad = F.count_if(~F.col("valid"))
    held = _files(spark, sf_dir).filter("language is not null")
    return held.cube("repo", "language").agg(F.count("*").alias("files"), bad.alias("invalid"), F.round(bad / F.count("*"), 6).alias("rate"), F.count_if(F.col("cause") == "conflict marker").alias("conflicts"), F.count_if(F.col("cause").startswith("wrong extension")).alias("wrong_extension"))


SQL: dict[str, str] = {}
QUERIES = {"p4_found": p4_found, "p4_failures": p4_failures, "p4_rates": p4_rates}
