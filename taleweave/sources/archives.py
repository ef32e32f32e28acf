"""Book archives as rows: members, metadata, manifest, spine and contents; and a guard against oversized ones.

Reading the packed bytes needs Python once (the standard library's zip and XML readers, a book and a member at a time); everything after is
relational. A book's package is the one its META-INF/container.xml names (without one, its first .opf), and its contents are the `toc` part of the
navigation document that the package's manifest marks, whatever its name; landmarks and page lists are no contents. Rejected archives are rows of their
own, not errors; a package or navigation document that is no XML gives no rows, and the book's files their names or headings as titles.
"""

import html
import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.operators import catalog, markup

#: Unpacked bytes that a book may have.
LARGEST = 400 << 20


#: Bytes of archives or members that Python is given at once; Spark's default is a fixed number of rows, however large.
_BATCH_BYTES, _SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(rows: DataFrame) -> DataFrame:
    """The rows, after the session's Arrow batches are bounded in bytes unless it says otherwise."""
    conf = rows.sparkSession.conf
    if _SETTING not in conf.getAll:
        conf.set(_SETTING, str(_BATCH_BYTES))
    return rows


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, path, content) of the .epub files under a folder; book_id is the file's stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("book_id"), "path", "content")


def write_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each (book_id, content) as a file of its own, <book_id>.epub, into a folder that all executors share; returns (book_id, bytes) of each.

    A task that runs again writes the same files again. Files are written when the result is read.
    """

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            place, path = fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{folder}")
            place.create_dir(path, recursive=True)
            for book, content in zip(batch.column("book_id").to_pylist(), batch.column("content")):
                with place.open_output_stream(f"{path}/{book}.epub") as file:
                    file.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column("book_id"), pa.array([len(c.as_buffer()) for c in batch.column("content")], pa.int64())], names=["book_id", "bytes"])

    return bounded_batches(archives).select(F.col("book_id").cast("string"), "content").mapInArrow(run, "book_id string, bytes long")


def listing(archives: DataFrame) -> DataFrame:
    """(book_id, member, file_size) from the archives' directories; member is null for what is no archive."""

    def run(frames):
        for frame in frames:
            rows = []
            for book, content in zip(frame["book_id"], frame["content"]):
                try:
                    rows += [(book, i.filename, i.file_size) for i in zipfile.ZipFile(io.BytesIO(content)).infolist()]
                except (zipfile.BadZipFile, ValueError, NotImplementedError, TypeError):
                    rows.append((book, None, None))
            yield pd.DataFrame(rows, columns=["book_id", "member", "file_size"]).astype({"file_size": "Int64"})

    book = archives.schema["book_id"].dataType.simpleString()
    return bounded_batches(archives).select("book_id", "content").mapInPandas(run, f"book_id {book}, member string, file_size long")


def judge(members: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(book_id, unpacked, verdict): accepted, too large, or not an archive."""
    sums = members.groupBy("book_id").agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("unpacked"), F.bool_or(F.col("member").isNull()).alias("_bad"))
    verdict = F.when(F.col("_bad"), "not an archive").when(F.col("unpacked") > largest, "too large").otherwise("accepted")
    return sums.select("book_id", "unpacked", verdict.alias("verdict"))


def members(archives: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(book_id, member, content) of the accepted archives. Each is opened once: its directory, at its end, is judged before a member is unpacked."""

    def run(frames):
        for frame in frames:
            for book, content in zip(frame["book_id"], frame["content"]):
                try:
                    packed = zipfile.ZipFile(io.BytesIO(content))
                except (zipfile.BadZipFile, ValueError, NotImplementedError, TypeError):
                    continue
                entries = packed.infolist()
                if sum(i.file_size for i in entries) <= largest:
                    for info in entries:
                        if not info.is_dir():
                            yield pd.DataFrame({"book_id": [book], "member": [info.filename], "content": [packed.read(info)]})

    book = archives.schema["book_id"].dataType.simpleString()
    return bounded_batches(archives).select("book_id", "content").mapInPandas(run, f"book_id {book}, member string, content binary")


_PACKAGE = (
    "book_id string, title string, author string, manifest array<struct<idref:string,href:string,media_type:string,is_cover:boolean,is_nav:boolean>>, "
    "spine array<struct<spine_no:int,idref:string>>, meta_cover string, guide array<string>"
)


def _local(element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _xml(content: bytes):
    """The root of a document, or None if it is no XML. HTML's named characters, which XML doesn't know, are read first."""
    try:
        return ElementTree.fromstring(content)
    except ElementTree.ParseError:
        known = re.sub(rb"&(?!(?:amp|lt|gt|quot|apos);)([A-Za-z][A-Za-z0-9]*;)", lambda m: html.unescape(m[0].decode()).encode("ascii", "xmlcharrefreplace"), content)
        try:
            return ElementTree.fromstring(known)
        except (ElementTree.ParseError, ValueError):
            return None
    except ValueError:  # an encoding that isn't known
        return None


def _resolved(folder: str, href: str) -> str:
    """A link's path from the archive's root, its fragment kept."""
    path, mark, fragment = href.partition("#")
    return posixpath.normpath(posixpath.join(folder, unquote(path))) + mark + fragment


def _package(book, member, root):
    folder, every = posixpath.dirname(member), {}
    for e in root.iter():
        every.setdefault(_local(e), []).append(e)
    text = lambda name: next((e.text.strip() for e in every.get(name, []) if e.text and e.text.strip()), None)
    at = lambda href: _resolved(folder, href.split("#")[0])
    has = lambda item, word: word in (item.get("properties") or "").split()
    items = [{"idref": i.get("id"), "href": at(i.get("href", "")), "media_type": i.get("media-type"), "is_cover": has(i, "cover-image"), "is_nav": has(i, "nav")} for i in every.get("item", [])]
    spine = [{"spine_no": n, "idref": i.get("idref")} for n, i in enumerate(every.get("itemref", []))]
    named = next((m.get("content") for m in every.get("meta", []) if m.get("name") == "cover"), None)
    guide = [at(r.get("href")) for r in every.get("reference", []) if r.get("type") == "cover" and r.get("href")]
    return (book, text("title") or book, text("creator") or "Unknown", items, spine, named, guide)


def package_members(parts: DataFrame) -> DataFrame:
    """(book_id, member) of each book's package: what META-INF/container.xml names first, else the first member that ends in .opf."""

    def run(frames):
        for frame in frames:
            rows = []
            for book, content in zip(frame["book_id"], frame["content"]):
                root = _xml(content)
                named = [e.get("full-path") for e in root.iter() if _local(e) == "rootfile" and e.get("full-path")] if root is not None else []
                rows += [(book, posixpath.normpath(named[0]))] if named else []
            yield pd.DataFrame(rows, columns=["book_id", "member"])

    book = parts.schema["book_id"].dataType.simpleString()
    named = parts.where("member = 'META-INF/container.xml'").select("book_id", "content").mapInPandas(run, f"book_id {book}, member string")
    named = named.join(parts.select("book_id", "member"), ["book_id", "member"], "left_semi").groupBy("book_id").agg(F.min("member").alias("member"))
    first = parts.where(F.col("member").rlike(r"(?i)\.opf$")).groupBy("book_id").agg(F.min("member").alias("member"))
    return named.unionByName(first.join(named, "book_id", "left_anti"))


def packages(parts: DataFrame) -> DataFrame:
    """One row per book from its package file: title (else the file's stem), author (else Unknown), manifest, spine and cover hints."""

    def run(frames):
        for frame in frames:
            read = [(str(book), member, _xml(content)) for book, member, content in zip(frame["book_id"], frame["member"], frame["content"])]
            yield pd.DataFrame([_package(*r) for r in read if r[2] is not None], columns=["book_id", "title", "author", "manifest", "spine", "meta_cover", "guide"])

    return parts.join(package_members(parts), ["book_id", "member"], "left_semi").select("book_id", "member", "content").mapInPandas(run, _PACKAGE)


def _entries(root):
    """(href or None, title) of the contents in their order: links and headings of the lists in the nav element of type toc, else in the first one."""
    kinds = lambda e: {w for name, value in e.attrib.items() if name.rpartition("}")[2] in ("type", "role") for w in value.split()}
    navs = [e for e in root.iter() if _local(e) == "nav"]
    toc = next((e for e in navs if kinds(e) & {"toc", "doc-toc"}), next((e for e in navs if not kinds(e)), None))
    for e in toc.iter() if toc is not None else ():
        if _local(e) == "a" and e.get("href"):
            yield e.get("href"), " ".join("".join(e.itertext()).split())
        elif _local(e) == "li":
            heading = next((c for c in e if _local(c) == "span"), None)
            if heading is not None and not any(_local(x) == "a" for x in heading.iter()):
                yield None, " ".join("".join(heading.itertext()).split())


def contents(parts: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """(book_id, ord, href, title) of the contents entries, nested ones after what they stand under; links are resolved, headings without one have none.

    books: the result of packages(parts), if it is there already; its manifests say which member is the navigation document.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for book, member, content in zip(frame["book_id"], frame["member"], frame["content"]):
                root = _xml(content)
                found = _entries(root) if root is not None else ()
                rows += [(str(book), n, None if href is None else _resolved(posixpath.dirname(member), href), title) for n, (href, title) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["book_id", "ord", "href", "title"]).astype({"ord": "int32"})

    items = (packages(parts) if books is None else books).select("book_id", F.explode("manifest").alias("m")).where("m.is_nav")
    nav = items.groupBy("book_id").agg(F.min("m.href").alias("member"))
    return parts.withColumn("book_id", F.col("book_id").cast("string")).join(nav, ["book_id", "member"]).select("book_id", "member", "content").mapInPandas(run, "book_id string, ord int, href string, title string")


DRAFTS = "book_id string, book_title string, author string, index long, title string, source string, include boolean, chars long"


def drafts(archives: DataFrame, largest: int = LARGEST) -> DataFrame:
    """The plan to review of each accepted book: its chapters with titles, where these come from, and whether to narrate them."""
    parts = members(archives, largest)
    books = packages(parts)
    spine = books.select("book_id", F.explode("spine").alias("s")).select("book_id", "s.spine_no", "s.idref")
    manifest = books.select("book_id", F.explode("manifest").alias("m")).select("book_id", "m.idref", "m.href")
    pages = parts.where(F.col("member").rlike(r"(?i)\.x?html?$")).select("book_id", F.col("member").alias("href"), F.decode("content", "UTF-8").alias("html"))
    documents = catalog.with_contents_titles(catalog.spine_documents(spine, manifest, pages), contents(parts, books))
    held = documents.withColumn("page", F.concat_ws("/", "book_id", F.col("spine_no").cast("string")))
    texts, headings = markup.chapter_text(markup.blocks(held, "page"), "page"), markup.headings(held, "page")
    chapters = catalog.resolve_titles(held.drop("html").join(texts, "page").join(headings, "page"), "spine_no")
    named = chapters.join(books.select("book_id", F.col("title").alias("book_title"), "author"), "book_id")
    return named.select("book_id", "book_title", "author", "index", "title", "source", (~F.col("front_matter")).alias("include"), F.length("text").cast("long").alias("chars"))
