"""Source files, from folders, a list of paths, a diff or a string."""

from __future__ import annotations

import os
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import rules
from codequarry.functions import text as T
from codequarry.php.lexer import class_declaration
from codequarry.registry import EngineConfig


class TargetError(ValueError):
    """A scan target that may not or cannot be read."""


def checked_target(root: str, target: str, config: EngineConfig = EngineConfig()) -> str:
    """The target's path below root; TargetError outside it, or when it is sensitive."""
    import re

    full = os.path.normpath(target if os.path.isabs(target) else os.path.join(root, target))
    base = os.path.normpath(root)
    if full != base and not full.startswith(base + os.sep):
        raise TargetError(f"outside the project: {target}")
    path = os.path.relpath(full, base).replace(os.sep, "/")
    for g in config.sensitive_patterns:
        if re.search(rules.glob_pattern(g), path if "/" in g else path.rsplit("/", 1)[-1]) or ("/" in g and (path + "/").startswith(g.strip("*/") + "/")):
            raise TargetError(f"sensitive: {target}")
    return path


def scan(spark: SparkSession, root: str, config: EngineConfig = EngineConfig(), paths=None) -> DataFrame:
    """(path, content, length) of the source files below root's configured folders, overlaps once.

    Names and sizes are tested before contents are decoded; binary files and
    what the exclude and sensitive patterns cover are left out.
    """
    wanted = [os.path.join(root, p) for p in (config.paths if paths is None else paths)]
    there = sorted({os.path.normpath(p) for p in wanted if "://" in p or os.path.exists(p)})
    there = [p for p in there if not any(p != q and p.startswith(q + os.sep) for q in there)]
    if not there:
        return spark.createDataFrame([], "path string, content string, length long")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there)
    name = T.normal_path(F.regexp_replace("path", "^file:/*", "/"), os.path.abspath(root) if "://" not in root else root)
    ends = F.lit(False)
    for e in config.file_extensions:
        ends = ends | F.col("path").endswith(e.lstrip("*"))
    files = raw.where(ends & (F.col("length") <= config.max_file_size_kb * 1024)).select(name.alias("path"), F.col("content").alias("bytes"), "length")
    files = files.where(~rules.excluded(F.col("path"), config.exclude) & ~rules.sensitive(F.col("path"), config.sensitive_patterns) & ~rules.binary(F.col("bytes")))
    content = F.col("bytes").cast("string")
    return files.select("path", (T.redact(content) if config.redact_secrets else content).alias("content"), "length")


def inline(spark: SparkSession, code: str) -> DataFrame:
    return spark.createDataFrame([("inline-code.php", code, len(code.encode()))], "path string, content string, length long")


def changed_paths(root: str, base: str | None = None) -> list[str]:
    """Added, copied, modified or renamed PHP files since base (main, master, or their remote forms)."""

    def git(*args):
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)

    for ref in [base] if base else ["main", "master", "origin/main", "origin/master"]:
        if git("rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}").returncode == 0:
            out = git("diff", "--relative", "--name-only", "--diff-filter=ACMR", f"{ref}...HEAD", "--", "*.php")
            return sorted(x for x in out.stdout.splitlines() if x)
    raise TargetError(f"no such base: {base or 'main or master'}")


def scan_diff(spark: SparkSession, root: str, base: str | None = None, config: EngineConfig = EngineConfig(), within=()) -> DataFrame:
    paths = spark.createDataFrame([(p,) for p in changed_paths(root, base)], "path string")
    paths = paths.where(~rules.sensitive_in_diff(F.col("path"), config.sensitive_patterns))
    if within:
        paths = paths.where(rules.within(F.col("path"), within))
    return scan(spark, root, config, ["."]).join(F.broadcast(paths), "path", "left_semi")


def roles(files: DataFrame) -> DataFrame:
    """Files with the role they play as context."""
    p = F.col("path")
    role = (
        F.when(p.rlike("^routes/"), "routes").when(p.rlike("^app/Http/Kernel\\.php$|^bootstrap/app\\.php$"), "kernel").when(p.rlike("^app/Http/Middleware/"), "middleware").when(p.rlike("^app/Policies/"), "policies")
        .when(p.rlike("^app/Http/Requests/"), "requests").when(p.rlike("^app/Models/"), "models").when(p.rlike("^app/Providers/"), "providers").when(p.rlike("^config/"), "config").otherwise("other")
    )
    return files.withColumn("role", role)


def classified(files: DataFrame) -> DataFrame:
    """With the class each file declares and its kind; Arrow batches through the lexer."""
    @F.pandas_udf("struct<class:string,extends:string>")
    def declared(content: pd.Series) -> pd.DataFrame:
        found = [class_declaration(c or "") or {} for c in content]
        return pd.DataFrame({"class": [d.get("class") for d in found], "extends": [d.get("extends") for d in found]})

    d = files.withColumn("_d", declared("content"))
    return d.withColumn("type", rules.file_type(F.col("path"), F.col("_d.class"), F.col("_d.extends"))).drop("_d")


def environment(files: DataFrame) -> DataFrame:
    """(path, app_env, app_debug) of environment files; nothing else of them is read."""
    value = lambda k: F.nullif(F.trim(F.regexp_extract("content", rf"(?m)^{k}=[\"']?([^\"'\r\n#]*)", 1)), F.lit(""))
    return files.select("path", value("APP_ENV").alias("app_env"), value("APP_DEBUG").alias("app_debug"))


def config_facts(files: DataFrame) -> DataFrame:
    """(path, key, values) of guards, origins, cookie and lifetime settings in configuration files."""
    items = F.array(
        *[F.struct(F.lit(k).alias("key"), F.regexp_extract_all("content", F.lit(p), F.lit(1)).alias("values")) for k, p in {
            "guard_driver": r"'driver'\s*=>\s*'([a-z_]+)'", "allowed_origin": r"'allowed_origins'\s*=>\s*\[\s*'([^']*)'", "supports_credentials": r"'supports_credentials'\s*=>\s*(true|false)",
            "secure": r"'secure'\s*=>\s*([^,\n]+)", "http_only": r"'http_only'\s*=>\s*([^,\n]+)", "same_site": r"'same_site'\s*=>\s*([^,\n]+)", "expiration": r"'expiration'\s*=>\s*([^,\n]+)",
        }.items()]
    )
    return files.select("path", F.explode(items).alias("i")).select("path", "i.*").where(F.size("values") > 0)
