"""Site repositories: a checkout or a landed tree of files becomes pages."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata import constants as C
from pagestrata.errors import AuditError
from pagestrata.functions import urls as U
from pagestrata.functions.source_code import capture_source, component_links
from pagestrata.operators.records import require_none
from pagestrata.session import cut_lineage
from pagestrata.sources.common import as_raw_pages, https_home, require_homepage


def local_commit(root: str) -> str | None:
    """The commit a checkout is at, or None."""
    try:
        done = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, timeout=5, check=True)
        return done.stdout.decode().strip()
    except (OSError, subprocess.SubprocessError):
        return None


ENTRIES = "folder string, name string, kind string, size long"
READ_BYTES = 16 << 20


def _file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def list_tree(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """Every entry below ``root``: folder, name, kind (file, folder, link), size; ignored folders are not entered.

    Folders are listed level by level, each by one task, as Spark's own listing leaves out names that
    begin with a dot or an underscore. More than ``most`` entries are an error.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = _file_system(root)
        for batch in batches:
            for folder in batch["folder"]:
                here = f"{base}/{folder}".rstrip("/")
                rows = []
                for info in system.get_file_info(fs.FileSelector(here)):
                    # A link is an entry, but neither followed nor read.
                    link = system.type_name == "local" and os.path.islink(info.path)
                    kind = "link" if link else "folder" if info.type == fs.FileType.Directory else "file"
                    rows.append((folder, info.base_name, kind, info.size or 0))
                yield pd.DataFrame(rows, columns=["folder", "name", "kind", "size"])

    level, levels, entries = spark.createDataFrame([("",)], "folder string"), [], 0
    while True:
        found = cut_lineage(level.mapInPandas(run, ENTRIES))
        levels.append(found)
        entries += found.count()
        if most is not None and entries > most:
            raise AuditError("INVALID_REPOSITORY_SOURCE", f"Repository contains more than {most:,} entries.")
        inner = found.where((F.col("kind") == "folder") & ~F.col("name").isin(C.IGNORED_DIRECTORIES))
        folders = inner.select(F.concat_ws("/", F.nullif("folder", F.lit("")), "name").alias("folder"))
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        level = folders.repartition(spark.sparkContext.defaultParallelism, "folder")


def repository_files(
    spark: SparkSession, root: str, entries: int | None = C.MAX_REPOSITORY_ENTRIES, file_bytes: int | None = C.MAX_REPOSITORY_FILE_BYTES,
) -> DataFrame:
    """Route and navigation files below ``root``: path, size, blob_sha, source.

    ``entries`` and ``file_bytes`` are the limits of the reference; None lifts them. Only files that are
    wanted are opened, a bounded number of bytes at a time.
    """
    path = F.concat_ws("/", F.nullif("folder", F.lit("")), "name")
    listed = list_tree(spark, root, entries).where(F.col("kind") == "file").select(path.alias("path"), "size")
    wanted = U.repository_route(F.col("path")).isNotNull() | U.is_navigation_source(F.col("path"))
    chosen = listed.where(wanted & (F.lit(True) if file_bytes is None else F.col("size") <= file_bytes))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _file_system(root)
        for batch in batches:
            groups = batch["size"].cumsum() // READ_BYTES
            for _, part in batch.groupby(groups):
                texts = []
                for name in part["path"]:
                    with system.open_input_stream(f"{base}/{name}") as file:
                        texts.append(file.read().decode("utf-8", "replace"))
                yield part.assign(blob_sha=None, source=texts)

    return chosen.mapInPandas(read, "path string, size long, blob_sha string, source string")


def read_tree(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """A landed tree (``tree.json`` as the interface gave it) and its blobs (``blobs``, JSON lines of sha, encoding, content)."""
    entry = "array<struct<path:string,type:string,size:long,sha:string>>"
    whole = spark.read.schema(f"sha string, truncated boolean, tree {entry}").json(f"{root}/tree.json", multiLine=True)
    require_none(whole.where(F.coalesce("truncated", F.lit(False)) | F.col("tree").isNull()).select("sha"), "INVALID_REPOSITORY_SOURCE",
                 "The repository tree is truncated. Use a checkout or a narrower repository.")
    blobs = spark.read.schema("sha string, encoding string, content string").json(f"{root}/blobs")
    return whole.select(F.inline("tree")), blobs


def tree_gaps(tree: DataFrame, blobs: DataFrame) -> DataFrame:
    """What is missing of a landed tree: folders of entries that are not listed, blobs that were not landed (path, problem)."""
    folders = tree.where(F.col("type") == "tree").select("path")
    parent = F.regexp_replace("path", r"/?[^/]*\z", "")
    parents = tree.select(parent.alias("path")).where(F.col("path") != "").distinct()
    unlisted = parents.join(folders, "path", "left_anti").withColumn("problem", F.lit("folder is not listed"))
    readable = blobs.where((F.coalesce("encoding", F.lit("base64")) == "base64") & F.col("content").isNotNull()).select("sha")
    lost = wanted_blobs(tree).join(readable, "sha", "left_anti").select("path", F.lit("blob was not landed").alias("problem"))
    return unlisted.unionByName(lost)


def wanted_blobs(tree: DataFrame, file_bytes: int | None = C.MAX_REPOSITORY_FILE_BYTES) -> DataFrame:
    small = F.lit(True) if file_bytes is None else F.col("size") <= file_bytes
    return tree.where((F.col("type") == "blob") & small & (U.repository_route(F.col("path")).isNotNull() | U.is_navigation_source(F.col("path"))))


def tree_files(tree: DataFrame, blobs: DataFrame) -> DataFrame:
    """Files of a landed tree (path, type, size, sha) with their base64 blobs (sha, content)."""
    text = F.decode(F.unbase64(F.regexp_replace("content", r"\s", "")), "UTF-8")
    once = blobs.select("sha", text.alias("source")).dropDuplicates(["sha"])
    return wanted_blobs(tree).join(once, "sha").select(
        U.repository_path(F.col("path")).alias("path"), F.col("size").cast("long").alias("size"), F.col("sha").alias("blob_sha"), "source"
    )


def check_repository(files: DataFrame, total_bytes: int | None = C.MAX_REPOSITORY_TOTAL_BYTES) -> None:
    if total_bytes is None:
        return
    row = files.agg(F.sum("size").alias("bytes")).first()
    if (row.bytes or 0) > total_bytes:
        raise AuditError("INVALID_REPOSITORY_SOURCE", f"Selected repository source files exceed the {total_bytes >> 20} MB input limit.")


def capture_files(files: DataFrame, primary_url: str, host: str) -> DataFrame:
    """One captured page per route file with readable copy, with where it came from."""
    extension = U.file_extension(F.col("path"))
    url = U.link_target(U.repository_route(F.col("path")), F.lit(primary_url))
    captured = (
        files.withColumns({"url": url, "extension": extension})
        .where(F.col("url").isNotNull())
        .withColumn("_c", capture_source(F.col("source"), F.col("extension"), F.col("url")))
        .where(F.size("_c.sections") > 0)
    )
    html = F.col("extension").isin("html", "htm")
    return captured.select(
        F.lit(host).alias("site"), F.lit(primary_url).alias("primary_url"), "url", "path", "blob_sha",
        *[F.col(f"_c.{c}").alias(c) for c in (
            "title", "meta_description", "language", "headings", "breadcrumbs", "links", "sections")],
        F.coalesce("_c.canonical_url", "url").alias("canonical_url"),
        (~html & (F.col("extension") != "md")).alias("partial_coverage"),
        F.when(html, "rendered-html-source").otherwise("static-source-extraction").alias("extraction"),
    )


def prefer_complete(pages: DataFrame) -> DataFrame:
    """One page per URL: a complete capture before a partial one, then the first path."""
    columns = [c for c in pages.columns if c not in ("site", "url")]
    best = F.min_by(F.struct(*columns), F.struct("partial_coverage", "path"))
    return pages.groupBy("site", "url").agg(best.alias("_best")).select("site", "url", "_best.*")


def with_navigation(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Adds the links of navigation files to the homepage, each distinct link once."""
    links = files.where(U.is_navigation_source(F.col("path"))).select(F.explode(component_links(F.col("source"))).alias("_link"))
    extra = links.distinct().agg(F.array_sort(F.collect_list("_link")).alias("_navigation"))
    home = F.col("url") == F.col("primary_url")
    joined = pages.withColumn("_home", home).join(extra.withColumn("_home", F.lit(True)), "_home", "left")
    merged = F.when(home, F.array_union("links", F.coalesce("_navigation", "links"))).otherwise(F.col("links"))
    return joined.withColumn("links", merged).drop("_home", "_navigation")


def ingest_repository(
    files: DataFrame, domain: str, method: str, repository: str, observed_at: Column,
    commit: str | None = None, ref: str | None = None, discovered: int = C.DEFAULT_LIMITS.discovered,
) -> DataFrame:
    """Raw pages of one site's repository files; it needs a homepage route."""
    primary_url, host = https_home(domain, "INVALID_REPOSITORY_SOURCE")
    if primary_url != f"https://{host}/":
        raise AuditError("INVALID_REPOSITORY_SOURCE", "Repository acquisition requires the website root URL.")
    check_repository(files)
    pages = with_navigation(prefer_complete(capture_files(files, primary_url, host)), files)
    provider = "github" if method == "github-repository" else "local-checkout"
    label = "github" if provider == "github" else "repository"
    raw = as_raw_pages(
        pages.select(
            "*", F.lit(method).alias("method"),
            F.lit(f"{label}:{repository}@{(commit or 'unversioned')[:12]}").alias("source_name"),
            F.lit(True).alias("owner_authorized"), observed_at.alias("acquired_at"),
            observed_at.alias("source_observed_at"), F.xxhash64("url").alias("ordinal"),
            F.struct(
                "path", "blob_sha", "extraction", F.lit(provider).alias("provider"),
                F.lit(repository).alias("repository"), F.lit(ref).cast("string").alias("ref"),
                F.lit(commit).cast("string").alias("commit_sha"),
            ).alias("repository_source"),
        )
    )
    require_none(raw.limit(discovered + 1).groupBy().count().where(F.col("count") > discovered),
                 "INVALID_REPOSITORY_SOURCE", "Repository exposes more routable pages than the discovery limit.")
    require_homepage(raw, "INVALID_REPOSITORY_SOURCE")
    return raw
