"""Web archives: index files, WARC records, replays, and both archives together.

Fetching is an outside step: index pages, records and replays are landed as files or tables, and
everything after that is a Spark job over them.
"""

from __future__ import annotations

import gzip
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pagestrata import constants as C
from pagestrata.errors import AuditError
from pagestrata.functions import urls as U
from pagestrata.functions.html import capture_html
from pagestrata.functions.text import archive_time, pinned, sections_digest
from pagestrata.operators.links import link_depth
from pagestrata.operators.reconcile import best_pages, best_records, reconcile
from pagestrata.operators.skew import newest
from pagestrata.session import cut_lineage
from pagestrata.sources.common import as_raw_pages

CDX_RECORD = "url string, status string, mime string, timestamp string, filename string, offset string, length string"


def collections(spark: SparkSession, path: str) -> DataFrame:
    """The newest collections that have an index (the list is in order, newest first)."""
    listed = spark.read.schema("id string, `cdx-api` string").json(path, multiLine=True)
    usable = listed.where(F.col("id").isNotNull() & F.col("`cdx-api`").isNotNull())
    return usable.select("id", F.col("`cdx-api`").alias("index_url")).limit(C.COMMON_CRAWL_COLLECTIONS)


def collection_query(host: Column, index_url: Column) -> Column:
    """Index request for the HTML captures of a host."""
    return F.concat(
        index_url, F.lit("?url="), F.url_encode(F.concat(host, F.lit("/*"))),
        F.lit("&output=json&filter=status%3A200&filter=mime%3Atext%2Fhtml&collapse=urlkey"),
    )


def cdx_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """Usable captures of a site from index lines (site, collection, line), the newest per URL.

    Lines that are no JSON or lack a field are passed over. All lines are aggregated before any cap.
    """
    filled = lambda c: F.col(f"_r.{c}").isNotNull() & (F.col(f"_r.{c}") != "")
    parsed = pinned(lines, _r=F.from_json(line, CDX_RECORD)).where(
        (F.col("_r.status") == "200") & filled("filename") & filled("offset") & filled("length")
        & filled("timestamp") & filled("url")
    )
    records = pinned(parsed, url=U.canonical_url(F.col("_r.url"))).where(
        U.same_host_https(F.col("url"), F.col("site"))
    ).select("site", "collection", "url", *[F.col(f"_r.{c}").alias(c) for c in ("timestamp", "filename", "offset", "length")])
    return newest(records, ["site", "url"], ["timestamp", "collection", "filename", "offset"])


def warc_ranges(records: DataFrame) -> DataFrame:
    """Adds record_url, byte_offset, byte_length and error_code of a record's place in its file."""
    offset, length = F.expr("try_cast(offset AS BIGINT)"), F.expr("try_cast(length AS BIGINT)")
    good = F.coalesce(
        (offset >= 0) & (length > 0) & (length <= C.DEFAULT_LIMITS.response_bytes), F.lit(False)
    )
    return records.withColumns(
        {
            "record_url": F.concat(F.lit(C.COMMON_CRAWL_DATA), "filename"),
            "byte_offset": offset, "byte_length": length,
            "byte_range": F.when(good, F.concat(
                F.lit("bytes="), offset.cast("string"), F.lit("-"), (offset + length - 1).cast("string"))),
            "error_code": F.when(~good, "INVALID_ARCHIVE_RECORD"),
        }
    )


def http_payload(record: bytes | None) -> tuple[str | None, str | None]:
    """HTML and error code of one gzip record: only a 200 response of type text/html counts."""
    try:
        plain = gzip.decompress(record or b"")
    except (OSError, EOFError):
        return None, "INVALID_ARCHIVE_RECORD"
    pieces = plain.split(b"\r\n\r\n", 2)
    if len(pieces) < 3:
        return None, "INVALID_ARCHIVE_RECORD"
    headers = pieces[1].decode("latin-1")
    ok = re.search(r"^HTTP/\d(?:\.\d)?\s+200\b", headers, re.M)
    html = re.search(r"content-type:\s*text/html\b", headers, re.I)
    if not (ok and html):
        return None, "INVALID_ARCHIVE_RECORD"
    return pieces[2].decode("utf-8", "replace"), None


# Neighbours in a file are read at once up to so many bytes, and across gaps of at most so many.
RUN_BYTES = 8 << 20
GAP_BYTES = 64 << 10


def fused(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Ranges (file, offset, length) sorted by file and offset as runs: file, start, end, and the ranges inside."""
    run: tuple | None = None
    for name, offset, length in rows:
        if run and run[0] == name and offset <= run[2] + GAP_BYTES and max(run[2], offset + length) - run[1] <= RUN_BYTES:
            run = (name, run[1], max(run[2], offset + length), [*run[3], (offset, length)])
            continue
        if run:
            yield run
        run = (name, offset, offset + length, [(offset, length)])
    if run:
        yield run


def read_ranges(rows: Iterator[tuple[str, int, int]], system, base: str) -> Iterator[bytes]:
    """The bytes of sorted ranges, in their order. A file is opened once; what cannot be read is empty."""
    name, file = None, None
    for run_name, start, end, ranges in fused(rows):
        try:
            if run_name != name:
                if file is not None:
                    file.close()
                name, file = run_name, None
                file = system.open_input_file(f"{base}/{run_name}")
            if file is None:
                raise OSError(run_name)
            file.seek(start)
            data = file.read(end - start)
        except (OSError, ValueError):
            data = b""
        for offset, length in ranges:
            yield data[offset - start:offset - start + length]
    if file is not None:
        file.close()


def read_warc_pages(ranges: DataFrame, root: str) -> DataFrame:
    """Adds html and error_code of each record, read as a range of its file under ``root``.

    Ranges are dealt out and sorted by file and offset, so a task opens a file once and reads its neighbours
    together. Records are decoded where they are read, a bounded number of bytes at a time, and rows leave
    record by record; bodies are never gathered. Ranges that are no ranges are failures.
    """
    known = [f for f in ranges.schema.fields if f.name not in ("html", "error_code")]
    out = StructType([*known, StructField("html", StringType()), StructField("error_code", StringType())])
    names = [f.name for f in known]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        waiting: deque = deque()

        def places():
            for batch in batches:
                for row in batch[[*names, "error_code"]].itertuples(index=False, name=None):
                    place = dict(zip(names, row))
                    waiting.append(row)
                    if row[-1] is None:
                        yield place["filename"], int(place["byte_offset"]), int(place["byte_length"])

        def one(row, html, code):
            return pd.DataFrame([[*row[:-1], html, code]], columns=[*names, "html", "error_code"])

        for data in read_ranges(places(), system, base):
            while waiting and waiting[0][-1] is not None:
                row = waiting.popleft()
                yield one(row, None, row[-1])
            yield one(waiting.popleft(), *http_payload(data))
        for row in waiting:
            yield one(row, None, row[-1])

    sorted_ranges = ranges.repartitionByRange("filename", "byte_offset").sortWithinPartitions("filename", "byte_offset")
    return sorted_ranges.mapInPandas(read, out)


def wayback_rows(pages: DataFrame, body: str = "body") -> DataFrame:
    """Index pages (site, page, body) as header, data rows and the key to resume with."""
    rows = F.from_json(body, "array<array<string>>")
    parsed = pinned(pages, _rows=rows).withColumn("header", F.get("_rows", F.lit(0)))
    ends = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size("_rows") - 2, F.lit(1))),
        lambda i: (F.size(F.get("_rows", i)) == 0) & (F.size(F.get("_rows", i + 1)) == 1),
    )
    end = F.get(ends, F.lit(0))
    key = F.get(F.get("_rows", end + 1), F.lit(0))
    fields = F.array(*[F.lit(f) for f in C.WAYBACK_FIELDS])
    asked = ["requested_key"] if "requested_key" in pages.columns else []
    return parsed.select(
        "site", "page", *asked, "header",
        F.coalesce(F.size(F.array_except(fields, "header")) == 0, F.lit(False)).alias("valid"),
        F.slice("_rows", F.lit(2), F.coalesce(end - 1, F.greatest(F.size("_rows") - 1, F.lit(0)))).alias("rows"),
        F.coalesce(F.try_url_decode(key), key).alias("resume_key"),
    )


def wayback_records(parsed: DataFrame) -> DataFrame:
    """HTML captures of the site: http becomes https, other hosts and broken rows are dropped."""
    rows = parsed.where("valid").select("site", "page", "header", F.posexplode("rows").alias("at", "_row"))
    # array_position is 0 where the header lacks the field, which get() turns into null.
    value = {f: F.get("_row", (F.array_position("header", f) - 1).cast("int")) for f in C.WAYBACK_FIELDS}
    records = rows.select(
        "site", "page", "at", *[F.coalesce(value[f], F.lit("")).alias(f) for f in ("digest", "length")],
        *[value[f].alias(f) for f in ("timestamp", "original", "mimetype", "statuscode")],
    ).where(
        F.col("timestamp").rlike(r"\A[0-9]{14}\z") & (F.col("statuscode") == "200")
        & F.col("mimetype").rlike(r"(?i)\Atext/html\b")
    )
    return pinned(records, url=U.archived_url(F.col("original"), F.col("site"))).where(F.col("url").isNotNull())


def newest_captures(records: DataFrame) -> DataFrame:
    return newest(records, ["site", "url"], ["timestamp", "digest", "original"])


def index_chain(parsed: DataFrame) -> DataFrame:
    """Index pages with their ``position``: a page follows the one whose resume key it was asked for with.

    ``requested_key`` is that key (null for the first page). Where it was not landed, the page with the
    number before is the one it followed. A page behind a gap has no position: what it followed is missing.
    """
    if "requested_key" not in parsed.columns:
        by_number = Window.partitionBy("site").orderBy("page")
        before = F.when(F.lag("page").over(by_number) == F.col("page") - 1, F.lag("resume_key").over(by_number))
        first = F.col("page") == F.min("page").over(Window.partitionBy("site"))
        parsed = parsed.withColumn("requested_key", F.when(~first, F.coalesce(before, F.lit("?")))).withColumn(
            "requested_key", F.when(first & (F.col("page") > 1), F.lit("?")).otherwise(F.col("requested_key")))
    parsed = cut_lineage(parsed)
    asked = F.coalesce("requested_key", F.lit(""))
    follows = parsed.where(F.col("resume_key").isNotNull()).select("site", asked.alias("source"), F.col("resume_key").alias("target"))
    places = link_depth(follows, parsed.select("site", F.lit("").alias("node")).distinct()).select(
        "site", F.col("node").alias("_asked"), F.col("depth").alias("position"))
    return parsed.withColumn("_asked", asked).join(places, ["site", "_asked"], "left").drop("_asked")


def index_gaps(chain: DataFrame) -> DataFrame:
    """Index pages that follow on nothing that was landed: (site, page, requested_key)."""
    return chain.where(F.col("position").isNull()).select("site", "page", "requested_key")


def index_state(parsed: DataFrame, most_pages: int = C.MAX_INDEX_PAGES) -> DataFrame:
    """Index pages read per site and whether the index goes on behind the page limit.

    The last page is the one with the greatest position in the chain, or number where there is no chain.
    """
    place = "position" if "position" in parsed.columns else "page"
    return parsed.groupBy("site").agg(
        F.count(F.lit(1)).alias("index_pages"), F.max_by("resume_key", place).alias("last_key")
    ).withColumn("truncated", F.col("last_key").isNotNull() & (F.col("index_pages") >= most_pages))


def refresh(known: DataFrame, latest: DataFrame) -> DataFrame:
    """Each known capture replaced by the newest one a later lookup found, where there is one."""
    found = newest_captures(latest)
    columns = [c for c in known.columns if c not in ("site", "url")]
    joined = known.alias("k").join(found.alias("l"), ["site", "url"], "left")
    return joined.select(
        "site", "url",
        *[(F.coalesce(f"l.{c}", f"k.{c}") if c in found.columns else F.col(f"k.{c}")).alias(c) for c in columns],
    )


def eligible_captures(records: DataFrame) -> DataFrame:
    """Not excluded by default, and not the homepage with a query."""
    variant = (U.url_path(F.col("url")) == "/") & (U.url_query(F.col("url")) != "")
    return records.where(U.exclusion_reason(F.col("url")).isNull() & ~variant)


def index_query(host: Column, remaining: Column, resume_key: Column) -> Column:
    """Request for one index page of a host."""
    size = F.least(F.lit(C.INDEX_PAGE_SIZE), remaining).cast("string")
    return F.concat(
        F.lit(f"https://{C.WAYBACK_HOST}/cdx/search/cdx?url="), F.url_encode(host),
        F.lit("&matchType=host&output=json&fl=" + "%2C".join(C.WAYBACK_FIELDS)
              + "&filter=statuscode%3A200&filter=mimetype%3Atext%2Fhtml&collapse=urlkey&limit="), size,
        F.lit("&showResumeKey=true"),
        F.when(resume_key.isNotNull(), F.concat(F.lit("&resumeKey="), F.url_encode(resume_key))).otherwise(""),
    )


def latest_query(url: Column) -> Column:
    """Request for the newest capture of one URL."""
    return F.concat(
        F.lit(f"https://{C.WAYBACK_HOST}/cdx/search/cdx?url="), F.url_encode(url),
        F.lit("&matchType=exact&output=json&fl=" + "%2C".join(C.WAYBACK_FIELDS)
              + "&filter=statuscode%3A200&filter=mimetype%3Atext%2Fhtml&fastLatest=true&limit=-1"),
    )


def archive_pages(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw pages and failures from captures with html.

    ``captures`` has site, primary_url, url, timestamp, html, error_code, method, source_name,
    collection, record_url, digest and original. A page without readable copy is a failure.
    """
    read = captures.withColumn("_c", capture_html(F.coalesce("html", F.lit(""))))
    problem = F.coalesce("error_code", F.when(F.size("_c.sections") == 0, "INVALID_ARCHIVE_RECORD"))
    judged = read.withColumn("_problem", problem)
    failures = judged.where(F.col("_problem").isNotNull()).select("site", "method", "url", F.col("_problem").alias("code"))
    stated = U.same_host_canonical(F.col("_c.canonical_url"), F.col("url"), F.col("site"))
    time = archive_time(F.col("timestamp"))
    pages = judged.where(F.col("_problem").isNull()).select(
        "site", "primary_url", "url", "method", "source_name", F.lit(False).alias("owner_authorized"),
        *[F.col(f"_c.{c}").alias(c) for c in ("title", "meta_description", "language", "headings", "breadcrumbs", "links", "sections")],
        F.when(F.col("_c.canonical_url").isNull(), F.col("url")).otherwise(stated).alias("canonical_url"),
        F.lit(False).alias("partial_coverage"), time.alias("source_observed_at"), time.alias("archive_timestamp"),
        F.col("collection").alias("archive_collection"), F.col("record_url").alias("archive_record_url"),
        F.col("digest").alias("archive_digest"), F.col("original").alias("archive_original_url"),
        F.xxhash64("url").alias("ordinal"), time.alias("acquired_at"),
    )
    return as_raw_pages(pages), failures


def common_crawl_captures(records: DataFrame, primary: DataFrame, fetched: int, root: str) -> DataFrame:
    """The best records of every site, read from WARC files under ``root``."""
    homes = records.join(primary, "site").withColumn("is_homepage", F.col("url") == F.col("primary_url"))
    chosen = warc_ranges(best_records(homes, fetched))
    read = read_warc_pages(chosen, root)
    return read.select(
        "site", "primary_url", "url", "timestamp", "html", "error_code", F.lit("common-crawl").alias("method"),
        F.col("collection").alias("source_name"), "collection", "record_url",
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("original"),
    )


def wayback_captures(records: DataFrame, primary: DataFrame, replays: DataFrame, fetched: int,
                     latest: DataFrame | None = None) -> DataFrame:
    """The best captures of every site with their landed replays (record_url, html, mime)."""
    homes = eligible_captures(records).join(primary, "site").withColumn("is_homepage", F.col("url") == F.col("primary_url"))
    chosen = best_records(homes, fetched)
    if latest is not None:
        chosen = refresh(chosen, latest)
    chosen = chosen.withColumn("record_url", U.replay_url(F.col("timestamp"), F.col("original")))
    joined = chosen.join(replays, "record_url", "left")
    readable = F.col("mime").isNull() | F.col("mime").rlike(r"(?i)\Atext/html\b|\Aapplication/xhtml\+xml\b")
    code = F.when(F.col("html").isNull(), "ARCHIVE_FETCH_FAILED").when(~readable, "INVALID_ARCHIVE_RECORD")
    return joined.select(
        "site", "primary_url", "url", "timestamp", "html", code.alias("error_code"),
        F.lit("wayback").alias("method"), F.lit(C.WAYBACK_NAME).alias("source_name"),
        F.lit(C.WAYBACK_NAME).alias("collection"), "record_url", "digest", "original",
    )


def archive_results(site_records: DataFrame, requested: DataFrame, pages: DataFrame, failures: DataFrame,
                    method: str) -> DataFrame:
    """Counts of one archive per site, as the source summary expects them."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("site").agg(F.count(F.lit(1)).alias(name))

    joined = (
        count(site_records, "indexed").join(count(requested, "requested"), "site", "left")
        .join(count(pages, "acquired"), "site", "left").join(count(failures, "failures"), "site", "left")
    )
    empty = F.when(F.coalesce("acquired", F.lit(0)) == 0, "ARCHIVE_EMPTY")
    return joined.na.fill(0).select(
        "site", F.lit(method).alias("source"), empty.alias("error_code"), "indexed", "requested", "acquired", "failures"
    )


def merge_archives(sources: dict[str, DataFrame | AuditError], fetched: int) -> tuple[DataFrame, list[str]]:
    """One page per URL from the pages of several archives, and the archives that gave none.

    A source that failed is left out; only if every source failed is that an error.
    """
    usable = {name: pages for name, pages in sources.items() if not isinstance(pages, AuditError)}
    if not usable:
        raise AuditError("ARCHIVE_EMPTY", "No public archive produced an eligible page set.")
    union = None
    for name, pages in usable.items():
        tagged = pages.withColumn("source", F.lit(name))
        union = tagged if union is None else union.unionByName(tagged)
    measured = union.withColumns(
        {
            "character_count": F.aggregate("sections", F.lit(0).cast("long"), lambda n, s: n + F.length(s["text"])),
            "content_digest": sections_digest(F.col("sections")),
        }
    )
    payload = [c for c in union.columns if c not in ("site", "url", "source")]
    merged = reconcile(measured, payload).withColumn("is_homepage", F.col("url") == F.col("primary_url"))
    best = best_pages(merged, fetched)
    return as_raw_pages(
        best.withColumns(
            {
                "method": F.lit("multi-archive"), "source_name": F.lit(C.MULTI_ARCHIVE_NAME),
                "archive_selected_source": F.col("selected_source"),
                "source_observed_at": F.coalesce("archive_timestamp", "source_observed_at"),
            }
        )
    ), [name for name in sources if name not in usable]


