"""Files as documents: scan, kind, skip rules, incremental scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import item
from ..storage import file_system

#: Extensions by kind.  Fixed values.
KINDS = {
    "Markdown": ("md", "mdx", "markdown"),
    "Code": (
        "rs", "py", "js", "ts", "tsx", "jsx", "go", "c", "cpp", "h", "hpp", "java", "rb", "ex", "exs", "zig", "lua", "sh", "bash", "zsh", "cs", "swift", "kt", "scala", "r", "R", "pl", "pm",
        "php",
    ),
    "Tabular": ("csv", "tsv", "parquet"),
    "PlainText": ("txt", "log", "cfg", "conf", "ini", "env", "toml", "yaml", "yml", "json", "xml"),
    "Transcript": ("srt", "vtt"),
}
#: What a walk leaves out: names, path components, hidden ones, extensions.  Fixed values.
SKIP_NAMES = ("MASCOT.md", "CLAUDE.md")
SKIP_PARTS = ("target", "node_modules", "__pycache__", "dist", "build", "vendor", "scripts", "qa")
HIDDEN = "."
SKIP_EXTENSIONS = (
    "lock", "png", "jpg", "jpeg", "gif", "ico", "svg", "woff", "woff2", "ttf", "eot", "otf", "zip", "tar", "gz", "bz2", "xz", "7z", "rar", "exe", "dll", "so", "dylib", "o", "a", "wasm", "pyc",
    "pyo", "class", "sqlite", "sqlite3", "db", "sqlite-shm", "sqlite-wal",
)
#: The index builder's own, shorter lists.  Fixed values.
BUILDER_PARTS = ("scripts", "target", "node_modules")
BUILDER_EXTENSIONS = ("lock", "png", "jpg", "jpeg", "gif", "ico", "svg", "woff", "woff2", "ttf", "eot", "otf", "exe", "dll", "so", "dylib", "o", "a", "wasm", "pyc", "pyo", "class")
ARCHIVES = ("zip", "tar", "gz", "bz2", "xz", "7z", "rar")


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name; null without one, or if the dot begins the name."""
    return F.nullif(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1), F.lit(""))


def content_kind(path: Column) -> Column:
    ext, out = extension(path), None
    for kind, known in KINDS.items():
        out = F.when(ext.isin(*known), kind) if out is None else out.when(ext.isin(*known), kind)
    return out.otherwise("Other")


def _any_part(path: Column, test) -> Column:
    return F.exists(F.split(path, "/"), test)


def skipped(path: Column) -> Column:
    """Whether a walk leaves the file out."""
    name = item(F.split(path, "/"), -1)
    return name.isin(*SKIP_NAMES) | _any_part(path, lambda p: p.isin(*SKIP_PARTS) | F.startswith(p, F.lit(HIDDEN))) | F.coalesce(extension(path).isin(*SKIP_EXTENSIONS), F.lit(False))


def builder_class(path: Column) -> Column:
    """``archive``, ``skipped`` or ``indexed`` by the index builder's rules."""
    hidden = _any_part(path, lambda p: F.startswith(p, F.lit(".")) | p.isin(*BUILDER_PARTS))
    ext = extension(path)
    return F.when(hidden | F.coalesce(ext.isin(*BUILDER_EXTENSIONS), F.lit(False)), "skipped").when(ext.isin(*ARCHIVES), "archive").otherwise("indexed")


def builder_counts(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.groupBy(builder_class(F.col(path)).alias("class")).agg(F.count("*").alias("n"))


def ignore_regex(pattern: str) -> str:
    """A gitignore pattern (without negation) as a regular expression on relative paths."""
    import re

    anchored, folder = "/" in pattern.strip("/"), pattern.endswith("/")
    body = ""
    i, p = 0, pattern.strip("/")
    while i < len(p):
        if p.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            body, i = body + ".*", i + 2
        elif p[i] == "*":
            body, i = body + "[^/]*", i + 1
        elif p[i] == "?":
            body, i = body + "[^/]", i + 1
        else:
            body, i = body + re.escape(p[i]), i + 1
    return ("^" if anchored else r"(?:^|/)") + body + ("/" if folder else r"(?:/|$)")


def ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether gitignore ``rules`` (folder they stand in, pattern) leave a file out.

    The last rule that fits decides; ``!`` takes a file back in, unless a folder above it is left out.
    """
    import re

    out = locked = F.lit(False)
    for folder, pattern in rules:
        negated = pattern.startswith("!")
        rule = ignore_regex(pattern.removeprefix("!").removeprefix("\\"))
        inside = F.startswith(path, F.lit(folder + "/")) if folder else F.lit(True)
        here = F.substring(path, len(folder) + 2, 2**31 - 1) if folder else path
        fits = inside & here.rlike(rule)
        out = F.when(fits, locked if negated else F.lit(True)).otherwise(out)
        if not negated:
            locked = locked | (inside & here.rlike(re.sub(r"\(\?:/\|\$\)$", "/", rule)))
    return out


def ignore_rules(spark: SparkSession, root: str, names: tuple[str, ...] = (".gitignore",), override: str | None = None, depth: int = 8) -> list[tuple[str, str]]:
    """The rules of the ignore files under ``root``, outer folders first.

    Where ``root`` holds a file called ``override``, files of that name are the only ones read.  Folders
    down to ``depth`` are looked into; the driver lists folders, not files.
    """
    jvm = spark.sparkContext._jvm
    fs, at = file_system(spark, root)
    if override and fs.exists(jvm.org.apache.hadoop.fs.Path(at, override)):
        names = (override,)
    base = fs.makeQualified(at).toString().rstrip("/")
    out = []
    for level in range(depth + 1):
        for name in names:
            for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(at, "*/" * level + name)) or []:
                stream = fs.open(status.getPath())
                try:
                    text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                folder = status.getPath().getParent().toString().removeprefix(base).strip("/")
                out += [(folder, line.rstrip()) for line in text.splitlines() if line.strip() and not line.startswith("#")]
    return out


def scan_directory(spark: SparkSession, root: str, ignore: list[str] = (), already: DataFrame | None = None, *, ignore_files: tuple[str, ...] = (".gitignore",), override: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (path, content, kind, mtime) under ``root``, and what was left out (path, reason).

    ``ignore`` has patterns of the caller's; ignore files of these names count too (none: ``()``), and an
    ``override`` file at the root takes their place.  Files that aren't UTF-8 are left out, as are those
    that ``already`` (path, mtime) has, and those whose names begin with a dot or an underscore, which
    Spark does not list.  Content is read only for what stays: the reasons are found on the listing's columns.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    files = files.withColumn("path", F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?(?=/)", ""), "^" + base.replace(".", r"\.") + "/", "")).withColumn("mtime", F.unix_timestamp("modificationTime"))
    reason = F.when(skipped(F.col("path")), "skipped")
    rules = [*ignore_rules(spark, root, ignore_files, override), *(("", p) for p in ignore)]
    if rules:
        reason = reason.when(ignored(F.col("path"), rules), "ignored")
    files = files.withColumn("reason", reason)
    kept = files.where("reason IS NULL")
    if already is not None:
        kept = kept.join(already.select("path", "mtime"), ["path", "mtime"], "left_anti")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    docs = kept.select("path", text.alias("content"), content_kind(F.col("path")).alias("kind"), "mtime").where(F.col("content").isNotNull())
    return docs, files.where("reason IS NOT NULL").select("path", "reason")


def as_documents(table: DataFrame) -> DataFrame:
    """The driver's ``documents`` as a corpus: path, content, kind, mtime, doc_id, source."""
    return table.select(F.concat_ws("", F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.col("text").alias("content"), F.lit("PlainText").alias("kind"), F.lit(0).cast("long").alias("mtime"), "doc_id", "source")


def new_only(files: DataFrame, already: DataFrame) -> DataFrame:
    """Files (path, mtime) that have not been indexed as they are."""
    return files.join(already.select("path", "mtime"), ["path", "mtime"], "left_anti")


def has_signal(token_estimate: Column, summary: Column) -> Column:
    """Stubs worth keeping: ten tokens and a summary of fifteen bytes at least."""
    return (token_estimate >= 10) & (F.octet_length(F.trim(summary)) >= 15)
