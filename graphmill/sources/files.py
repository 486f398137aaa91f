"""File sources and sinks: code discovery, manifests, snapshots, commits and changed files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Language by file extension, one map for all uses.
LANGUAGE = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "java": "java", "go": "go", "rs": "rust", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "php": "php", "rb": "ruby", "kt": "kotlin", "scala": "scala", "swift": "swift", "json": "json", "yaml": "yaml", "yml": "yaml", "properties": "properties", "env": "properties", "ttl": "turtle",
}
#: Folders that hold no sources of a project.
SKIPPED = ("node_modules", ".git", "dist", "build", "target", "coverage", ".next", "__pycache__", "vendor", ".venv")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """Language by the extension, null for others."""
    pairs = [F.lit(x) for pair in LANGUAGE.items() for x in pair]
    return F.element_at(F.create_map(*pairs), extension(path))


def wanted(path: Column, include: str | None = None, exclude: str | None = None) -> Column:
    """Whether a path is outside of the skipped folders and fits the patterns."""
    good = ~path.rlike(r"(?:^|/)(?:" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + r")/")
    if include:
        good = good & path.rlike(include)
    return good & ~path.rlike(exclude) if exclude else good


def discover(spark: SparkSession, root: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """`path, language, size, modified, text` of the source files below a folder, recursively; unknown kinds are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inner = files.where(wanted(F.col("path"), include, exclude)).withColumn("language", language(F.col("path"))).where("language is not null")
    return inner.select("path", "language", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "utf-8").alias("text"))


def lines_between(text: Column, first: int, last: int) -> Column:
    """Lines of a text by number, from 1, both ends included; what lies outside is left out."""
    rows = F.split(text, "\n")
    return F.array_join(F.slice(rows, F.lit(first), F.greatest(F.lit(0), F.least(F.lit(last), F.size(rows)) - first + 1)), "\n")


def structure(files: DataFrame) -> DataFrame:
    """Files and bytes per folder and language."""
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))


def modules(files: DataFrame) -> DataFrame:
    """Folders with an entry file, by the kind of the entry."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    kind = F.when(name.isin("package.json"), "node").when(name.isin("pom.xml", "build.gradle"), "java").when(name.isin("go.mod"), "go").when(name.isin("Cargo.toml"), "rust").when(name.isin("__init__.py", "setup.py", "pyproject.toml"), "python").when(name.rlike(r"^index\.[jt]sx?$"), "entry")
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), kind.alias("kind")).where("kind is not null").distinct()


def package_manifest(texts: DataFrame, text: str) -> DataFrame:
    """`path, name, scope, version` of the dependencies of package.json texts; broken texts have none."""
    parsed = F.from_json(text, "dependencies map<string,string>, devDependencies map<string,string>")

    def scoped(part: str, scope: str) -> Column:
        entries = F.map_entries(F.coalesce(F.col("m")[part], F.create_map().cast("map<string,string>")))
        return F.transform(entries, lambda e: F.struct(e["key"].alias("name"), F.lit(scope).alias("scope"), e["value"].alias("version")))

    both = F.concat(scoped("dependencies", "prod"), scoped("devDependencies", "dev"))
    return texts.withColumn("m", parsed).where("m is not null").select("path", F.inline(both))


def requirements(texts: DataFrame, text: str) -> DataFrame:
    """`path, name, version` of the lines of requirements.txt texts; remarks, options and blank lines are skipped."""
    line = F.trim(F.regexp_replace(F.col("l"), r"#.*$", ""))
    rows = texts.select("path", F.explode(F.split(text, "\n")).alias("l")).select("path", line.alias("l")).where(r"l rlike '^[A-Za-z0-9]'")
    return rows.select("path", F.regexp_extract("l", r"^([A-Za-z0-9_.\-]+)", 1).alias("name"), F.nullif(F.regexp_extract("l", r"[=~<>!]=?=?\s*([\w.*]+)", 1), F.lit("")).alias("version"))


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def changed_files(diff: DataFrame, line: str) -> DataFrame:
    """`status, path, old_path` of name-status lines: A, M, D and renames."""
    parts = F.split(line, "\t")
    code = F.substring(parts[0], 1, 1)
    status = F.when(code == "A", "added").when(code == "D", "deleted").when(code == "R", "renamed").otherwise("modified")
    return diff.where(F.size(parts) >= 2).select(status.alias("status"), F.element_at(parts, -1).alias("path"), F.when(code == "R", parts[1]).alias("old_path"))


def commits_since(commits: DataFrame, repository: str, after: str | None, most: int = 10) -> DataFrame:
    """Commits of a repository after the given hash, or the newest `most` of each if there is no such commit."""
    newest = Window.partitionBy(repository).orderBy(F.desc("ts"), F.desc("hash"))
    ranked = commits.withColumn("_n", F.row_number().over(newest))
    mark = ranked.where(F.col("hash") == after).select(repository, F.col("_n").alias("_m"))
    joined = ranked.join(mark, repository, "left")
    return joined.where(F.col("_n") < F.coalesce("_m", F.lit(most + 1))).drop("_n", "_m")


def keep_backups(copies: DataFrame, key: str, ts: str, n: int) -> DataFrame:
    """The newest n copies of each key."""
    return copies.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts)))).where(F.col("_n") <= n).drop("_n")


MOST_BYTES = 1 << 20


def read_lines(root: str, path: str, first: int = 1, last: int | None = None) -> str:
    """Lines of a file below a root, both ends included. A path that leads out of the root and a file above MOST_BYTES are refused."""
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, path))
    if os.path.commonpath([base, full]) != base:
        raise ValueError(f"{path} is not below {root}")
    if os.path.getsize(full) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    with open(full, encoding="utf-8") as lines:
        return "".join(line for n, line in enumerate(lines, 1) if n >= first and (last is None or n <= last))


def project(files: DataFrame) -> DataFrame:
    """`build_tool, language, n_files` from the names of all files: what builds a project and what it is written in."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    tool = F.when(name == "package.json", "npm").when(name == "pom.xml", "maven").when(name.rlike(r"^build\.gradle"), "gradle").when(name == "go.mod", "go").when(name == "Cargo.toml", "cargo").when(name.isin("pyproject.toml", "setup.py", "requirements.txt"), "pip").when(name == "Makefile", "make")
    return files.groupBy(tool.alias("build_tool"), language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n_files")).where("build_tool is not null or language is not null")
