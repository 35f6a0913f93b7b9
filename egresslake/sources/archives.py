"""Many archives and drawings at once: Spark lists and reads the files, each task parses its own.

Files come through the binaryFile source, so they may lie in any store that Spark reads, and nothing passes through the driver. A file is
parsed where it was read; a task holds one file, and its members or entities leave it in batches.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from egresslake.functions.text import decimal_comma
from egresslake.operators.calibration import COUNTDOWN_MS

#: Rows that a parser hands over at a time.
ROWS = 5000
ENTITIES = "path string, entity int, kind string, layer string, xs array<double>, ys array<double>, radius double, closed boolean"


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return df.select("path", "content")


def _batches(rows: Iterator[tuple], columns: Sequence[str]) -> Iterator[pd.DataFrame]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= ROWS:
            yield pd.DataFrame(held, columns=list(columns))
            held = []
    if held:
        yield pd.DataFrame(held, columns=list(columns))


def archive_rows(spark: SparkSession, path: str, member: str = "*.csv", glob: str = "*.zip") -> DataFrame:
    """(path, member, line, fields map): CSV rows inside all zip archives below a path; members are chosen by a pattern on their name.

    Lines count from 1 after the header. Rows shorter than the header lack the last fields, longer ones lose the rest; a file
    that is no archive gives an error that names it.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                yield from _batches(rows_of(name, content), ["path", "member", "line", "fields"])

    def rows_of(name: str, content: bytes) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            raise ValueError(f"no zip archive: {name}") from e
        with archive as z:
            for inside in sorted(z.namelist()):
                if fnmatch(inside.rsplit("/", 1)[-1], member):
                    with z.open(inside) as f:
                        lines = csv.reader(io.TextIOWrapper(f, "utf-8-sig"))
                        header = next(lines, [])
                        for n, row in enumerate(lines, 1):
                            yield name, inside, n, dict(zip(header, row, strict=False))

    return _files(spark, path, glob).mapInPandas(parse, "path string, member string, line long, fields map<string,string>")


def archive_csv(spark: SparkSession, path: str, columns: Sequence[str], member: str = "*.csv", glob: str = "*.zip") -> DataFrame:
    """archive_rows with the given columns as strings; a column that a member's header lacks is NULL."""
    df = archive_rows(spark, path, member, glob)
    return df.select("path", "member", "line", *[F.col("fields")[c].alias(c) for c in columns])


# Metres that the letters of a task name stand for.
WIDTHS, LENGTHS = {"W": 4.0, "N": 2.0, "E": 2.0}, {"S": 10.0, "M": 15.0, "L": 20.0}
TASK = r"^(?:[0-9]+_)?L-([WNE])([SML])([01])_R-([WNE])([SML])([01])(?:_.+)?$"


def task_fields(task: Column) -> dict[str, Column]:
    """Widths, lengths and stairs of the left and the right way from a task's name; NULL for names of another form."""
    ok = task.rlike(TASK)

    def part(k: int) -> Column:
        return F.regexp_extract(task, TASK, k)

    def metres(k: int, of: Mapping[str, float]) -> Column:
        out = F.lit(None).cast("double")
        for letter, m in of.items():
            out = F.when(part(k) == letter, m).otherwise(out)
        return F.when(ok, out)

    out = {}
    for side, k in (("left", 1), ("right", 4)):
        out |= {f"{side}_width_m": metres(k, WIDTHS), f"{side}_length_m": metres(k + 1, LENGTHS), f"{side}_stairs": F.when(ok, F.try_to_number(part(k + 2), F.lit("9")).cast("int"))}
    return out


def choice_features(choices: DataFrame, task: str = "taskId") -> DataFrame:
    """choices with the fields of their task and what the right way has more of: width, shortness, stairs. Other tasks are left out."""
    d = choices.withColumns(task_fields(F.col(task))).filter("left_width_m is not null")
    return d.withColumns({
        "right_width_advantage_m": F.col("right_width_m") - F.col("left_width_m"), "right_shortness_advantage_m": F.col("left_length_m") - F.col("right_length_m"),
        "right_stairs_advantage": F.col("right_stairs") - F.col("left_stairs"),
    })


def route_observations(responses: DataFrame, confidence: DataFrame) -> DataFrame:
    """Choices of corridors as calibration.route_choice_fit takes them: user_id, task_count, task_id, choice_right, the features, decision_time_ms, confidence.

    responses: userId, taskId, taskCount, AOI, time (what was left of the countdown); confidence: userId, taskId, taskCount, confidence, line (of equal ones the last counts).
    Training tasks, clicks beside the corridors, rows without a number of the task or a time, and tasks whose name does not tell its corridors are left out. The
    choice before is 1 right, -1 left, 0 none; progress is the share of the greatest task number of all.
    """
    t, n = F.col("taskId"), F.col("taskCount").try_cast("double")
    training = t.endswith("_tr") | t.contains("_tr_")
    d = responses.withColumns({"_n": n, "time_remaining_ms": decimal_comma(F.col("time"))}).filter(F.col("AOI").isin("corridor_left", "corridor_right") & F.col("_n").isNotNull() & F.col("time_remaining_ms").isNotNull() & ~F.coalesce(training, F.lit(False)))
    most = d.agg(F.greatest(F.max("_n"), F.lit(1.0)).alias("_most"))  # one row
    d = choice_features(d).withColumn("choice_right", (F.col("AOI") == "corridor_right").cast("int"))
    before = F.lag("choice_right").over(Window.partitionBy("userId").orderBy("_n", "taskId"))
    d = d.withColumn("previous_choice_right", F.when(before == 1, 1.0).when(before == 0, -1.0).otherwise(0.0)).withColumn("task_count", F.col("_n").cast("int")).crossJoin(F.broadcast(most))
    keys = ["user_id", "task_id", "task_count"]
    c = confidence.select(F.col("userId").alias("user_id"), F.col("taskId").alias("task_id"), F.col("taskCount").try_cast("double").cast("int").alias("task_count"), F.col("confidence").try_cast("double").alias("confidence"), "line").filter("task_count is not null and confidence is not null")
    c = c.groupBy(*keys).agg(F.max_by("confidence", "line").alias("confidence"))
    d = d.select(
        F.col("userId").alias("user_id"), F.col("taskId").alias("task_id"), "task_count", "choice_right", *[c for c in d.columns if c.startswith(("left_", "right_"))], "previous_choice_right",
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("task_count") / F.col("_most"))).alias("trial_progress"), "time_remaining_ms", F.greatest(F.lit(0.0), COUNTDOWN_MS - F.col("time_remaining_ms")).alias("decision_time_ms"),
    )
    return d.join(c, keys, "left")


def decimal(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with columns of numbers that may have a decimal comma as doubles; NULL where there is none."""
    return df.withColumns({c: decimal_comma(F.col(c)) for c in columns})


def entities(pairs: Sequence[tuple[str, str]]) -> Iterator[tuple[str, str, list[float], list[float], float | None, bool]]:
    """(kind, layer, xs, ys, radius, closed) of the ENTITIES sections of code and value pairs; entities that lack a part are left out.

    A POLYLINE takes the VERTEX records up to its SEQEND.
    """
    section, current, after_section = "", None, False
    done: list[dict] = []

    def new(kind: str) -> dict:
        return {"kind": kind, "layer": "0", "x": [], "y": [], "r": None, "flags": 0}

    open_line: dict | None = None
    for code, value in [*pairs, ("0", "EOF")]:
        if code == "0":
            kind = value.upper()
            if current is not None and current["kind"] == "VERTEX" and open_line is not None and current["x"] and current["y"]:
                open_line["x"].append(current["x"][0])
                open_line["y"].append(current["y"][0])
            if kind not in ("VERTEX", "SEQEND"):
                open_line = None
            current, after_section = None, kind == "SECTION"
            if kind in ("ENDSEC", "EOF", "SECTION"):
                section = ""
            elif section == "ENTITIES" and kind == "VERTEX":
                current = new(kind)
            elif section == "ENTITIES" and kind in ("LINE", "CIRCLE", "POINT", "LWPOLYLINE", "POLYLINE"):
                current = new(kind)
                done.append(current)
                open_line = current if kind == "POLYLINE" else None
        elif after_section:
            section, after_section = (value.upper() if code == "2" else section), False
        elif current is not None:
            if code == "8":
                current["layer"] = value
            elif code == "70":
                current["flags"] = int(float(value))
            elif code == "40":
                current["r"] = float(value)
            elif code in ("10", "11") and not (current["kind"] == "POLYLINE"):
                current["x"].append(float(value))
            elif code in ("20", "21") and not (current["kind"] == "POLYLINE"):
                current["y"].append(float(value))
    need = {"LINE": 2, "CIRCLE": 1, "POINT": 1, "LWPOLYLINE": 2, "POLYLINE": 2}
    for e in done:
        n = min(len(e["x"]), len(e["y"]))
        if n >= need[e["kind"]] and not (e["kind"] == "CIRCLE" and e["r"] is None):
            n = need[e["kind"]] if e["kind"] in ("LINE", "CIRCLE", "POINT") else n
            yield e["kind"], e["layer"], e["x"][:n], e["y"][:n], e["r"] if e["kind"] == "CIRCLE" else None, bool(e["flags"] & 1)


def drawings(spark: SparkSession, path: str, glob: str = "*.dxf") -> DataFrame:
    """(path, entity, kind, layer, xs, ys, radius, closed) of all drawings below a path. A file with half a pair gives an error that names it."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                lines = [x.strip() for x in content.decode("utf-8-sig", "replace").splitlines()]
                if len(lines) % 2:
                    raise ValueError(f"a code without a value: {name}")
                found = entities(list(zip(lines[::2], lines[1::2], strict=True)))
                yield from _batches(((name, k, *e) for k, e in enumerate(found)), [c.split()[0] for c in ENTITIES.split(", ")])

    return _files(spark, path, glob).mapInPandas(parse, ENTITIES)


def roles(drawn: DataFrame, layers: Mapping[str, Sequence[str]], default: str = "obstacle") -> DataFrame:
    """drawn with role: that of the entity's layer, in any case; the default for layers that no role names."""
    role = F.lit(default.lower())
    for name, of in reversed(list(layers.items())):
        role = F.when(F.upper("layer").isin([x.upper() for x in of]), name.lower()).otherwise(role)
    return drawn.withColumn("role", role)


def extents(drawn: DataFrame) -> DataFrame:
    """(path, min_x, min_y, max_x, max_y) of each drawing, circles with their radius."""
    r = F.coalesce("radius", F.lit(0.0))
    return drawn.groupBy("path").agg(
        F.min(F.array_min("xs") - r).alias("min_x"), F.min(F.array_min("ys") - r).alias("min_y"), F.max(F.array_max("xs") + r).alias("max_x"), F.max(F.array_max("ys") + r).alias("max_y")
    )
