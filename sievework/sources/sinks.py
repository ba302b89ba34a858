"""Sinks: CSV and JSON exports of ranked results and versioned snapshots."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse


def csv_columns(df: DataFrame, missing: str = "unknown") -> DataFrame:
    """Every column as text: lists joined by ``; ``, dates by day, missing values named."""
    out: list[Column] = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("array"):
            c = F.array_join(c, "; ")
        elif kind.startswith("timestamp") or kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "boolean":
            c = F.when(c, "yes").otherwise("no")
        elif kind == "double":
            c = F.format_string("%.2f", c)
        out.append(F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(missing)).alias(name))
    return df.select(*out)


#: Columns of a report, in order.
REPORT = (
    "score confidence recommendation company title location remote salary experienceRequired postedAt source jobUrl applicationUrl matchingSkills missingSkills reasons concerns providerUsed isNew"
).split()


def report_rows(ranked: DataFrame, missing: str = "unknown") -> DataFrame:
    """The columns of REPORT as a report shows them.

    ``ranked``: a posting's columns beside score, confidence, recommendation,
    matching_skills, missing_skills, reasons, concerns, provider_used, is_new.
    """
    told = lambda c: F.coalesce(F.col(c), F.lit(missing))
    listed = lambda c: F.coalesce(F.array_join(c, "; "), F.lit(""))
    out = {
        "score": F.col("score"), "confidence": F.floor(F.col("confidence") * 100 + 0.5) / 100, "recommendation": F.col("recommendation"), "company": F.col("company"), "title": F.col("title"), "location": told("location"), "remote": told("remote"),
        "salary": parse.format_salary(*[F.col(f"salary.{k}") for k in ("currency", "min", "max", "period", "raw")], missing),
        "experienceRequired": parse.format_experience(*[F.col(f"experience_required.{k}") for k in ("min_years", "max_years", "raw")], missing),
        "postedAt": F.coalesce(F.date_format("posted_at", "yyyy-MM-dd"), F.lit(missing)), "source": F.col("source"), "jobUrl": F.col("url"), "applicationUrl": F.coalesce("application_url", "url"),
        "matchingSkills": listed("matching_skills"), "missingSkills": listed("missing_skills"), "reasons": listed("reasons"), "concerns": listed("concerns"), "providerUsed": F.col("provider_used"),
        "isNew": F.when(F.col("is_new"), "yes").otherwise("no"),
    }
    return ranked.select(*[out[c].alias(c) for c in REPORT])


def report_name(prefix: str, extension: str, day) -> str:
    """The file of a day's report."""
    return f"{prefix}-{day:%Y-%m-%d}.{extension}"


def summary_text(sources: dict[str, int], funnel: dict[str, int], labels: dict[str, int], reasons: dict[str, int], best: list[tuple[float, str, str, str]], errors: list[str]) -> str:
    """A run's report as plain text, from counts and a few rows already on the driver."""
    lines = ["Sources:", *[f"  {name + ':':<18}{n:>8}" for name, n in sources.items()], f"  {'total:':<18}{sum(sources.values()):>8}", ""]
    lines += [*[f"{name + ':':<20}{n:>8}" for name, n in funnel.items()], "", "Results:", *[f"  {name + ':':<18}{n:>8}" for name, n in labels.items()]]
    if reasons:
        lines += ["", "Reasons:", *[f"  - {name}: {n}" for name, n in sorted(reasons.items(), key=lambda x: (-x[1], x[0]))]]
    if best:
        lines += ["", "Best matches:", *[f"  {score:>5g}  {label:<14} {company} \u2014 {title}" for score, label, company, title in best]]
    if errors:
        lines += ["", "Errors:", *[f"  - {e}" for e in errors]]
    return "\n".join(lines) + "\n"


def write_csv(df: DataFrame, path: str, missing: str = "unknown") -> None:
    """A directory of CSV files with header, written in parallel; spreadsheets need :func:`write_csv_file`."""
    csv_columns(df, missing).write.mode("overwrite").csv(path, header=True, escape='"')


def write_csv_file(df: DataFrame, path: str, limit: int = 100_000) -> int:
    """One file with byte order mark for a report of at most ``limit`` rows; a longer one is refused."""
    import csv

    rows = csv_columns(df).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: use write_csv")
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(tmp, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        w.writerows(rows)
    os.replace(tmp, path)
    return len(rows)


def write_json_file(df: DataFrame, path: str, meta: dict, limit: int = 100_000) -> int:
    """One document of ``meta`` and ``jobs`` for a report of at most ``limit`` rows."""
    rows = df.select(F.to_json(F.struct("*")).alias("j")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump({"meta": meta, "jobs": [json.loads(r.j) for r in rows]}, f, ensure_ascii=False)
    os.replace(tmp, path)
    return len(rows)


class Snapshots:
    """A table kept as versions; the greatest committed one is the table.

    A version is written in full before its commit file, which names its folder, is
    moved to ``commits/N`` in one step: readers never see half a write, a crash
    leaves the last version standing, nothing is overwritten, and a writer that
    finds its version committed is refused.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> dict[int, str]:
        p = self._fs_path(f"{self.path}/commits")
        names = [x.getPath().getName() for x in self.fs.listStatus(p)] if self.fs.exists(p) else []
        return {int(n): n for n in names if n.isdigit()}

    def version(self) -> int:
        return max(self._commits(), default=0)

    def read(self, version: int | None = None) -> DataFrame | None:
        v = self.version() if version is None else version
        return self.spark.read.parquet(self._data(v)) if v else None

    def _data(self, v: int) -> str:
        """The folder of a committed version, which its commit's first line names."""
        return f"{self.path}/{self.spark.read.text(f'{self.path}/commits/{v}').first()[0]}"

    def write(self, df: DataFrame) -> int:
        v = self.version() + 1
        folder = f"v={v}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        tmp, commit = self._fs_path(f"{self.path}/{folder}.commit"), self._fs_path(f"{self.path}/commits/{v}")
        out = self.fs.create(tmp, False)
        out.writeBytes(folder)
        out.close()
        self.fs.mkdirs(commit.getParent())
        if self.fs.exists(commit) or not self.fs.rename(tmp, commit):
            self.fs.delete(tmp, False)
            raise ValueError(f"version {v} was committed by another writer")
        return v
