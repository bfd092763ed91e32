"""Paths as templates over keys: 'raw/{subject}/{session}.csv'."""

from __future__ import annotations

import ast
import json
import re
from functools import reduce
from itertools import product as cartesian
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELD = re.compile(r"\{(\w+)\}")


class PathTemplate:
    def __init__(self, template: str, root: str = ""):
        self.template, self.root = template, root.rstrip("/")
        self.fields = list(dict.fromkeys(_FIELD.findall(template)))

    def path(self, **keys) -> str:
        """The path at these keys."""
        made = self.template.format(**keys)
        return f"{self.root}/{made}" if self.root else made

    def key(self) -> str:
        """The template as text, for version keys; `parse` reads it back."""
        return json.dumps({"path_template": self.template, "root": self.root}, sort_keys=True)

    @staticmethod
    def parse(text: str) -> PathTemplate | None:
        """The template that a text stands for: `key` or the older `PathTemplate('template', 'root')`; None for others."""
        if text.startswith("{"):
            try:
                found = json.loads(text)
            except json.JSONDecodeError:
                return None
            return PathTemplate(found["path_template"], found.get("root") or "") if "path_template" in found else None
        try:
            call = ast.parse(text, mode="eval").body
            arguments = [ast.literal_eval(a) for a in call.args] if isinstance(call, ast.Call) and getattr(call.func, "id", "") == "PathTemplate" else []
        except (SyntaxError, ValueError):
            return None
        return PathTemplate(*arguments) if arguments and all(isinstance(a, str) for a in arguments) else None

    def column(self) -> Column:
        """The path as an expression over columns named like the fields."""
        text = f"{self.root}/{self.template}" if self.root else self.template
        parts = _FIELD.split(text)
        return F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts) if p or i % 2])

    def product(self, **values: list) -> list[tuple[str, dict]]:
        """(path, keys) for every combination of values."""
        names = list(values)
        return [(self.path(**dict(zip(names, combo))), dict(zip(names, combo))) for combo in cartesian(*values.values())]

    def pattern(self) -> str:
        """A regular expression with a group for each field as it occurs, in order."""
        parts = _FIELD.split(self.template)
        return "/?" + "".join(re.escape(p) if i % 2 == 0 else "([^/]+?)" for i, p in enumerate(parts)) + "$"

    def matches(self, paths: DataFrame, column: str = "path") -> DataFrame:
        """The keys in each path of a column; paths that don't match, or in which a repeated field differs, are left out."""
        occurrences = _FIELD.findall(self.template)
        whole = r"^.*?" + self.pattern() if self.root == "" else "^" + re.escape(self.root) + self.pattern()
        found = paths.where(F.col(column).rlike(whole))
        each = [F.regexp_extract(column, whole, i + 1) for i in range(len(occurrences))]
        first = {name: each[occurrences.index(name)] for name in self.fields}
        same = [first[name] == e for name, e in zip(occurrences, each)]
        return found.where(reduce(lambda a, b: a & b, same, F.lit(True))).withColumns(first).orderBy(column)

    def discover(self, spark: SparkSession) -> DataFrame:
        """(path, *fields) of the files under the root that fit, listed by Spark on any file system it reads."""
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root or ".").select(F.regexp_replace("path", r"^file:(//)?", "").alias("path"))
        root = str(PurePosixPath(self.root)) if self.root else ""
        return PathTemplate(self.template, root).matches(files)
