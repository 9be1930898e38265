"""Driver-side configuration: YAML, smell names, output gates, copy plans, run counters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_sections(text: str) -> dict[str, dict[str, list[str]]]:
    """section -> key -> list from YAML of two levels; scalars, lists and mappings of nulls are accepted."""
    try:
        import yaml

        raw = yaml.safe_load(text) or {}
    except ImportError:
        raw = _parse_plain(text)
    out: dict[str, dict[str, list[str]]] = {}
    for section, entries in raw.items():
        out[section] = {}
        for key, value in (entries or {}).items():
            items = [] if value is None else list(value) if isinstance(value, (list, tuple, dict)) else [value]
            out[section][str(key)] = [str(i) for i in items]
    return out


def _parse_plain(text: str) -> dict:
    """The same grammar by indentation: sections at 0, keys at 2, items below."""
    out: dict = {}
    section = key = None
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        if indent == 0 and body.endswith(":"):
            section = out.setdefault(body[:-1], {})
        elif body.startswith("- ") and section is not None and key is not None:
            section[key].append(body[2:].strip().strip("'\""))
        elif section is not None and ":" in body:
            key, _, value = body.partition(":")
            key = key.strip()
            section[key] = [v.strip().strip("'\"") for v in value.strip().strip("[]").split(",") if v.strip()]
    return out


def groups_frame(spark: SparkSession, groups: dict[str, list[str]]) -> DataFrame:
    """(grp, experiment) of a group section."""
    rows = [(g, m) for g, members in groups.items() for m in members]
    return spark.createDataFrame(rows, "grp string, experiment string")


def smell_acronyms(config: dict[str, dict[str, list[str]]], detector: str) -> dict[str, str]:
    """Full name -> acronym."""
    return {name: values[0] for name, values in config.get(detector, {}).items() if values}


def smell_names(acronyms: dict[str, str]) -> dict[str, str]:
    """Acronym -> full name; the first wins."""
    out: dict[str, str] = {}
    for name, acronym in acronyms.items():
        out.setdefault(acronym, name)
    return out


#: Columns that a pivot over tools may make.
MOST_TOOLS = 1000


@dataclass
class RunCounts:
    """What a run made anew, skipped, deleted and wrote."""

    recreated: int = 0
    skipped: int = 0
    deleted: int = 0
    empty: int = 0
    rows_written: int = 0
    notes: list[str] = field(default_factory=list)

    def wrote(self, rows: int) -> None:
        self.recreated += 1
        self.rows_written += rows
        self.empty += rows == 0


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    store, hadoop = _path(spark, path)
    return store.exists(hadoop)


def should_generate(spark: SparkSession, path: str, replace: bool, counts: RunCounts) -> bool:
    """False (and counted) where the output is there and need not be replaced."""
    if not replace and exists(spark, path):
        counts.skipped += 1
        return False
    return True


def remove_stale(spark: SparkSession, path: str, reason: str, counts: RunCounts) -> None:
    """Deletes an output whose inputs are gone."""
    store, hadoop = _path(spark, path)
    if store.exists(hadoop):
        store.delete(hadoop, True)
        counts.deleted += 1
        counts.notes.append(reason)


def plan_copies(projects: DataFrame, artifacts: DataFrame, source: str, destination: str) -> DataFrame:
    """project x artifact with both paths: every artifact for every project, so the grid is the result."""
    grid = projects.select("project").crossJoin(artifacts.select("artifact"))
    path = lambda root: F.concat(F.lit(root.rstrip("/") + "/"), "artifact", F.lit("/"), "project", F.lit(".csv"))
    return grid.withColumns({"source": path(source), "destination": path(destination)})


def run_copies(spark: SparkSession, plan: Iterable, replace: bool = False, dry_run: bool = False) -> list[tuple[str, str]]:
    """(destination, status): missing, skipped, planned or copied."""
    out = []
    for row in plan:
        (source_fs, source), (target_fs, target) = _path(spark, row["source"]), _path(spark, row["destination"])
        if not source_fs.exists(source):
            status = "missing"
        elif target_fs.exists(target) and not replace:
            status = "skipped"
        elif dry_run:
            status = "planned"
        else:
            conf = spark.sparkContext._jsc.hadoopConfiguration()
            spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(source_fs, source, target_fs, target, False, True, conf)
            status = "copied"
        out.append((row["destination"], status))
    return out


def project_index(projects: DataFrame, relations: dict[str, DataFrame], histories: DataFrame | None = None) -> DataFrame:
    """Projects with row counts of each relation and of each tool's histories (0 where none).

    Tools become columns, so more than MOST_TOOLS of them are an error.
    """
    out = projects
    for name, rows in relations.items():
        counts = rows.groupBy("project").agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, "project", "left").na.fill(0, [name])
    if histories is not None:
        tools = sorted(r[0] for r in histories.select("tool").distinct().limit(MOST_TOOLS + 1).collect())
        if len(tools) > MOST_TOOLS:
            raise ValueError(f"more than {MOST_TOOLS} tools")
        wide = histories.groupBy("project").pivot("tool", tools).agg(F.count(F.lit(1)))
        out = out.join(wide, "project", "left").na.fill(0, tools)
    return out


def job_ranges(indexes: Sequence[int], done: Sequence[int] = (), cap: int = 9999) -> list[tuple[int, int]]:
    """Runs of consecutive open indexes within the cap."""
    left = sorted({i for i in indexes if i <= cap} - set(done))
    out: list[tuple[int, int]] = []
    for i in left:
        if out and out[-1][1] == i - 1:
            out[-1] = (out[-1][0], i)
        else:
            out.append((i, i))
    return out
