"""Sessions, settings and what to check before a run."""

from __future__ import annotations

import json
import shutil
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that a cluster's own are preferred to: they apply only where nothing is set.
DEFAULTS = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}


@dataclass(frozen=True)
class Settings:
    """Folders are relative to the file that the settings were read from."""

    tables: str
    output: str
    app_name: str = "lakeloom"
    master: str | None = None
    spark: dict = field(default_factory=dict)
    base: str = "."

    def path(self, value: str) -> str:
        return value if "://" in value or Path(value).is_absolute() else str(Path(self.base) / value)


def load_settings(path: str) -> Settings:
    """Settings from a JSON file; a name that is not known is an error."""
    file = Path(path).resolve()
    given = json.loads(file.read_text(encoding="utf-8"))
    unknown = set(given) - {f.name for f in fields(Settings)} | {"base"} & set(given)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Settings(**given, base=str(file.parent))


def preflight(settings: Settings) -> dict:
    """{ok, problems}: whether Java is found and local folders of tables exist; nothing is started."""
    problems = []
    if shutil.which("java") is None:
        problems.append("java is not on the path")
    tables = settings.path(settings.tables)
    if "://" not in tables and not Path(tables).is_dir():
        problems.append(f"no folder of tables: {tables}")
    return {"ok": not problems, "problems": problems}


def session(settings: Settings) -> SparkSession:
    builder = SparkSession.builder.appName(settings.app_name)
    if settings.master:
        builder = builder.master(settings.master)
    for name, value in settings.spark.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    set_already = dict(spark.sparkContext.getConf().getAll()) | dict(settings.spark)
    for name, value in DEFAULTS.items():
        if name not in set_already:
            spark.conf.set(name, value)
    return spark
