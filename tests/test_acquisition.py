"""Trees, archive ranges, index chains and both archives under one budget."""

import base64
import gzip
import io
import json

import pytest

from pagestrata.constants import DEFAULT_LIMITS
from pagestrata.errors import AuditError
from pagestrata.sources import archives as A
from pagestrata.sources import dispatch as D
from pagestrata.sources import repositories as RP

HOME = "<html><head><title>{0}</title></head><body><nav><a href='/product'>P</a></nav><main><h1>{0}</h1><p>Copy of {0}.</p></main></body></html>"


def test_names_that_begin_with_dots_and_underscores(spark, tmp_path):
    files = {"_site/index.html": HOME.format("Home"), "src/_components/Header.tsx": "<header><a href='/product'>P</a></header>", ".well/page.html": HOME.format("W"),
             "src/app/page.tsx": "export default () => <main><h1>App</h1><p>Copy here.</p></main>", "node_modules/a/index.html": "x", "big.html": "y" * 50, "empty/": None}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).mkdir() if text is None else (tmp_path / name).write_text(text)
    (tmp_path / "linked.html").symlink_to(tmp_path / "_site/index.html")
    (tmp_path / "loop").symlink_to(tmp_path)
    listed = RP.list_tree(spark, str(tmp_path))
    kinds = {f"{r.folder}/{r.name}".lstrip("/"): r.kind for r in listed.collect()}
    assert kinds["linked.html"] == kinds["loop"] == "link" and kinds["node_modules"] == "folder" and "node_modules/a" not in kinds
    read = {r.path: r.source for r in RP.repository_files(spark, str(tmp_path), file_bytes=300).collect()}
    assert read["src/_components/Header.tsx"] == files["src/_components/Header.tsx"] and "linked.html" not in read
    assert {"_site/index.html", "big.html", "src/app/page.tsx"} & set(read) == {p for p in ("_site/index.html", "big.html", "src/app/page.tsx") if p in read}
    assert "src/app/page.tsx" in read and len(files["_site/index.html"]) < 300
    with pytest.raises(AuditError):
        RP.repository_files(spark, str(tmp_path), entries=3)


def test_landed_tree(spark, tmp_path):
    texts = {"src/app/page.tsx": "export default () => <main><h1>Home</h1><p>Copy here.</p></main>", "src/app/plans/page.tsx": "<main><h1>Plans</h1><p>More copy.</p></main>"}
    tree = [{"path": p, "type": "tree", "size": None, "sha": p} for p in ("src", "src/app", "src/app/plans")]
    tree += [{"path": p, "type": "blob", "size": len(t), "sha": f"sha-{i}"} for i, (p, t) in enumerate(texts.items())]
    blobs = [{"sha": f"sha-{i}", "encoding": "base64", "content": base64.encodebytes(t.encode()).decode()} for i, t in enumerate(texts.values())]

    def land(tree, blobs, truncated=False):
        (tmp_path / "tree.json").write_text(json.dumps({"sha": "c", "truncated": truncated, "tree": tree}))
        (tmp_path / "blobs").mkdir(exist_ok=True)
        (tmp_path / "blobs/b.json").write_text("\n".join(map(json.dumps, blobs)))
        return D.acquire(spark, {"repository_tree": str(tmp_path), "domain": "https://example.com", "observed_at": "2026-07-01", "commit": "d" * 40})

    pages = {r.url: r for r in land(tree, blobs).collect()}
    assert set(pages) == {"https://example.com/", "https://example.com/plans"}
    assert pages["https://example.com/"].source_name == "github:repository@dddddddddddd" and pages["https://example.com/"].repository_source.blob_sha == "sha-0"
    for broken in ((tree, blobs, True), (tree, blobs[:1]), (tree[1:], blobs)):
        with pytest.raises(AuditError) as error:
            land(*broken)
        assert error.value.code == "INVALID_REPOSITORY_SOURCE"


class Files:
    """A file system that counts what is opened."""

    def __init__(self, files):
        self.files, self.opened, self.reads = files, [], []

    def open_input_file(self, path):
        self.opened.append(path)
        if path not in self.files:
            raise FileNotFoundError(path)
        outer, file = self, io.BytesIO(self.files[path])

        class Counted:
            seek, close = file.seek, file.close

            def read(self, n):
                outer.reads.append(n)
                return file.read(n)

        return Counted()


def test_ranges_are_fused_and_files_opened_once():
    data = bytes(range(256)) * 40_000
    files = Files({"/a": data, "/b": data})
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 100_000, 7), ("a", 9_000_000, 9), ("a", 9_000_005, 9), ("b", 5, 5), ("gone", 1, 2), ("gone", 5, 2)]
    got = list(A.read_ranges(iter(rows), files, ""))
    assert got == [data[o:o + n] if f != "gone" else b"" for f, o, n in rows]
    assert files.opened.count("/a") == files.opened.count("/b") == 1 and len(files.reads) == 4
    assert all(end - start <= max(A.RUN_BYTES, 6 << 20) for _, start, end, _ in A.fused(iter([("x", i * 3_000_000, 5_000_000) for i in range(50)])))


def index_pages(spark, keys, numbers=None):
    """Pages that were asked for with one key and end with another."""
    header = json.dumps(["timestamp", "original", "mimetype", "statuscode", "digest", "length"])
    rows = [("a.com", n, asked, f"[{header}, [], [\"{ends}\"]]" if ends else f"[{header}]") for n, (asked, ends) in zip(numbers or range(1, 99), keys)]
    return A.wayback_rows(spark.createDataFrame(rows, "site string, page int, requested_key string, body string"))


def test_index_pages_are_ordered_by_their_keys(spark):
    keys = [(None, "k1"), *[(f"k{i}", f"k{i + 1}") for i in range(1, 10)], ("k10", "k11")]
    shuffled = [11, 3, 7, 1, 2, 10, 9, 8, 4, 5, 6]
    chain = A.index_chain(index_pages(spark, keys, shuffled))
    assert {r.page: r.position for r in chain.collect()} == {n: i for i, n in enumerate(shuffled)}
    state = A.index_state(chain).first()
    assert (state.last_key, state.index_pages, state.truncated) == ("k11", 11, True) and A.index_gaps(chain).isEmpty()
    gap = A.index_chain(index_pages(spark, [k for k in keys if k[0] != "k4"]))
    assert {r.requested_key for r in A.index_gaps(gap).collect()} == {f"k{i}" for i in range(5, 11)}
    # Without keys, numbers say what follows what: page 10 follows page 9, and a missing number is a gap.
    numbered = A.index_chain(index_pages(spark, keys, range(1, 12)).drop("requested_key"))
    assert A.index_state(numbered).first().last_key == "k11" and A.index_gaps(numbered).isEmpty()
    missing = A.index_chain(index_pages(spark, keys, range(1, 12)).drop("requested_key").where("page <> 4"))
    assert {r.page for r in A.index_gaps(missing).collect()} == set(range(5, 12))


def common_crawl(root, pages):
    """A landed archive: WARC file and index lines."""
    (root / "index/CC-1").mkdir(parents=True)
    lines, body = [], b""
    for path, html in pages.items():
        record = gzip.compress(f"WARC/1.0\r\nx: y\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n{html}".encode())
        lines.append(json.dumps({"url": f"https://example.com{path}", "status": "200", "timestamp": "20260601000000", "filename": "w.gz", "offset": str(len(body)), "length": str(len(record))}))
        body += record
    (root / "w.gz").write_bytes(body)
    (root / "index/CC-1/i.json").write_text("\n".join(lines))
    return str(root)


def wayback(spark, root, replays, paths):
    (root / "index").mkdir(parents=True)
    header = ["timestamp", "original", "mimetype", "statuscode", "digest", "length"]
    rows = [["20260701000000", f"https://example.com{p}", "text/html", "200", f"D{p}", "9"] for p in paths]
    (root / "index/page-1.json").write_text(json.dumps([header, *rows]))
    frame = [(f"https://web.archive.org/web/20260701000000id_/https://example.com{p}", html, "text/html") for p, html in replays.items()]
    spark.createDataFrame(frame, "record_url string, html string, mime string").write.parquet(f"{root}/replays")
    return str(root)


def test_both_archives_share_one_budget(spark, tmp_path):
    """One archive is partial, the other whole; then one is lost altogether."""
    paths = ["/", "/product", "/pricing", "/about", "/team", "/blog/x", "/blog/y"]
    crawl = common_crawl(tmp_path / "cc", {p: HOME.format(f"c{p}") for p in paths})
    replays = wayback(spark, tmp_path / "wb", {"/": HOME.format("w/"), "/product": "<html></html>"}, ["/", "/product", "/other"])
    limits = DEFAULT_LIMITS.lowered(discovered=20, fetched=7, analyzed=7)
    options = {"archives": True, "common_crawl": crawl, "wayback": replays, "domain": "https://example.com"}
    given = D.acquired(spark, options, limits)
    facts = {r.source: r for r in given.sources.collect()}
    assert (facts["common-crawl"].status, facts["common-crawl"].indexed_records, facts["common-crawl"].requested_records, facts["common-crawl"].acquired_records) == ("passed", 7, 4, 4)
    assert (facts["wayback"].status, facts["wayback"].indexed_records, facts["wayback"].requested_records, facts["wayback"].acquired_records, facts["wayback"].failure_count) == ("partial", 3, 3, 1, 2)
    assert {(r.url, r.code) for r in given.failures.collect()} == {("https://example.com/product", "INVALID_ARCHIVE_RECORD"), ("https://example.com/other", "ARCHIVE_FETCH_FAILED")}
    pages = {r.url: r for r in given.pages.collect()}
    assert len(pages) == 4 and pages["https://example.com/"].archive_selected_source == "wayback" and pages["https://example.com/"].method == "multi-archive"
    lost = D.acquired(spark, {**options, "wayback": str(tmp_path / "nothing")}, limits)
    status = {r.source: (r.status, r.failure_count) for r in lost.sources.collect()}
    assert status == {"common-crawl": ("passed", 0), "wayback": ("failed", 1)} and lost.pages.count() == 4
    assert [(r.method, r.url) for r in lost.failures.collect()] == [("wayback", None)]
    with pytest.raises(AuditError) as error:
        D.acquired(spark, {**options, "wayback": str(tmp_path / "no"), "common_crawl": str(tmp_path / "no")}, limits)
    assert error.value.code == "ARCHIVE_EMPTY"
    with pytest.raises(AuditError):
        D.acquired(spark, options, DEFAULT_LIMITS.lowered(fetched=1))
