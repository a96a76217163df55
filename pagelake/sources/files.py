"""Files as blocks: text, CSV records, EPUB members, archives.

Every reader takes rows ``path string, content binary`` (as ``binaryFile`` gives
them) and works file by file inside tasks.
"""

from __future__ import annotations

import csv
import hashlib
import io
import itertools
import lzma
import stat
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions import urls
from pagelake.operators.shared import let, slices

ARCHIVES = (".7z", ".bz2", ".gz", ".rar", ".tar", ".tgz", ".zip")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def text_blocks(files: DataFrame) -> DataFrame:
    """The whole file as one block; bytes that are not UTF-8 are replaced."""
    return files.select("path", F.lit("line:1").alias("locator"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


#: Characters that one CSV field may have.
MAX_FIELD = 10_000_000


def csv_rows(files: DataFrame) -> DataFrame:
    """Every physical record, the header too: ``path, locator, cells, error``.

    A file that is no CSV gives the records before the fault and one row with the error.
    """

    def records(content: bytes | None) -> Iterator[tuple]:
        csv.field_size_limit(MAX_FIELD)
        n = 0
        try:
            if content is None:
                raise csv.Error("no content")
            for n, cells in enumerate(csv.reader(io.StringIO(bytes(content).decode("utf-8-sig", "replace"))), 1):
                yield f"row:{n}", cells, None
        except csv.Error as error:
            yield f"row:{n + 1}", None, str(error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = records(content)
                while some := list(itertools.islice(rows, 10_000)):
                    yield pd.DataFrame([(path, *r) for r in some], columns=["path", "locator", "cells", "error"])

    return files.mapInPandas(run, "path string, locator string, cells array<string>, error string")


def _safe(name: str) -> bool:
    path = PurePosixPath(name)
    return not path.is_absolute() and ".." not in path.parts and "\0" not in name


#: What a broken or hostile archive may raise while it is read.
BROKEN = (ValueError, RuntimeError, NotImplementedError, EOFError, OSError, KeyError, zipfile.BadZipFile, zlib.error, lzma.LZMAError, tarfile.TarError)


def epub_members(files: DataFrame, members: int = 1000, *, expanded: int = 50_000_000, ratio: float = 100.0) -> DataFrame:
    """HTML members of EPUB files with tags as spaces: ``path, locator, text, error``.

    Members past the first ``members`` and those with unsafe names are left out; a file
    that is no zip, or expands too far, gives one row with the error.
    """

    def texts(content: bytes | None) -> list[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(content or b""))) as box:
                found = [i for i in box.infolist() if i.filename.lower().endswith((".html", ".xhtml"))][:members]
                found = [i for i in found if _safe(i.filename)]
                if sum(i.file_size for i in found) > expanded:
                    raise ValueError("archive expanded-byte limit exceeded")
                if any(i.file_size > ratio * max(1, i.compress_size) for i in found):
                    raise ValueError("archive compression ratio exceeded")
                return [(f"member:{i.filename}", box.read(i).decode("utf-8", "replace"), None) for i in found]
        except BROKEN as error:
            return [(None, None, str(error) or type(error).__name__)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.select(["path", "content"]), "content"):
                rows = ((path, *r) for path, content in zip(*(c.to_pylist() for c in part.columns)) for r in texts(content))
                while some := list(itertools.islice(rows, 100)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*some)], ["path", "locator", "raw", "error"])

    made = files.mapInArrow(run, "path string, locator string, raw string, error string")
    return made.select("path", "locator", F.regexp_replace("raw", r"(?s)<[^>]+>", " ").alias("text"), "error")


def _members(body: bytes, most: int, expanded: int, ratio: float) -> list[tuple[str, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(body)):
        box = zipfile.ZipFile(io.BytesIO(body))
        found = [(i.filename, i.file_size, i.compress_size, stat.S_ISLNK(i.external_attr >> 16), i.is_dir(), lambda i=i: box.read(i)) for i in box.infolist()]
    else:
        try:
            box = tarfile.open(fileobj=io.BytesIO(body), mode="r:*")
        except tarfile.ReadError:
            raise ValueError("unsupported or malformed archive") from None
        found = [(m.name, m.size, None, m.issym() or m.islnk() or m.isdev(), not m.isfile(), lambda m=m: box.extractfile(m).read()) for m in box.getmembers()]
    with box:
        if len(found) > most:
            raise ValueError("archive member limit exceeded")
        out, total = [], 0
        for name, size, packed, link, folder, read in found:
            if not _safe(name):
                raise ValueError("archive path traversal detected")
            if link:
                raise ValueError("archive links and devices are forbidden")
            if folder:
                continue
            total += size
            if (size / max(1, packed) if packed is not None else total / max(1, len(body))) > ratio:
                raise ValueError("archive compression ratio exceeded")
            if total > expanded:
                raise ValueError("archive expanded-byte limit exceeded")
            if PurePosixPath(name.lower()).suffix in ARCHIVES:
                raise ValueError("nested archives are not expanded")
            out.append((name, read()))
        return out


def archive_members(files: DataFrame, *, members: int = 1000, expanded: int = 50_000_000, ratio: float = 100.0) -> DataFrame:
    """Members of zip and tar files: ``path, member, size, sha256, content, error``.

    An archive that breaks a rule gives one row with the error and no member.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, body in zip(pdf["path"], pdf["content"]):
                try:
                    rows = [(path, n, len(c), hashlib.sha256(c).hexdigest(), c, None) for n, c in _members(bytes(body or b""), members, expanded, ratio)]
                except BROKEN as error:
                    rows = [(path, None, None, None, None, str(error) or type(error).__name__)]
                out = pd.DataFrame(rows, columns=["path", "member", "size", "sha256", "content", "error"])
                yield out.astype({"size": "Int64"})

    return files.mapInPandas(run, "path string, member string, size long, sha256 string, content binary, error string")


#: Format by suffix, and of a zip container by suffix.
FORMATS = {".csv": "csv", ".docx": "docx", ".epub": "epub", ".pdf": "pdf", ".pptx": "pptx", ".txt": "plain_text_file", ".xls": "xls", ".xlsx": "xlsx"}
ZIPPED = {".docx": "docx", ".pptx": "pptx", ".xlsx": "xlsx", ".epub": "epub"}


def format_route(path: Column, content: Column) -> Column:
    """Format of a file: its signature first, then its suffix, else text."""
    end = urls.suffix(path)
    pick = lambda table, rest: F.coalesce(*[F.when(end == k, v) for k, v in table.items()], F.lit(rest))
    head = F.hex(F.substring(content, 1, 5))
    return F.when(head == "255044462D", "pdf").when(F.startswith(head, F.lit("504B0304")), pick(ZIPPED, "docx")).otherwise(pick(FORMATS, "plain_text_file"))


def blocks_to_text(blocks: DataFrame, key: str, order: str) -> DataFrame:
    """Text of each document: blocks in order, a line each (``text`` or ``cells``)."""
    cells = F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " ")
    line = F.struct(order, F.coalesce("text", cells).alias("x"), "locator")
    found = blocks.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("b"))
    return found.select(key, F.array_join(F.transform("b", lambda x: F.coalesce(x["x"], F.lit(""))), "\n").alias("text"), F.transform("b", lambda x: x["locator"]).alias("locators"))


#: Characters that JSON writes in two letters; other control characters are written by their number.
SHORT_ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_string(text: Column) -> Column:
    """A text as a JSON string; other letters stay as they are."""
    made = text
    for char, written_as in (SHORT_ESCAPES | {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in SHORT_ESCAPES}).items():
        made = F.replace(made, F.lit(char), F.lit(written_as))
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f"\\]'), made).otherwise(text), F.lit('"'))


def json_double(value: Column) -> Column:
    """A double in the fewest digits that give it back, with an exponent below 1e-4 and from 1e16; null if JSON has no such number."""
    text = F.abs(value).cast("string")

    def cut(t: Column) -> Column:
        """Digits without outer zeros, and the place of the point among them."""
        whole, part = F.regexp_extract(t, r"^([0-9]*)", 1), F.regexp_extract(t, r"\.([0-9]*)", 1)
        power = F.coalesce(F.nullif(F.regexp_extract(t, r"E(-?[0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
        all_ = F.concat(whole, part)
        kept = F.ltrim(all_, F.lit("0"))
        return F.struct(F.rtrim(kept, F.lit("0")).alias("d"), (F.length(whole) + power - F.length(all_) + F.length(kept)).alias("p"))

    def shorter(x: Column) -> Column:
        """One digit less, rounded down or up, if that is the same double."""
        less = F.left(x["d"], F.length(x["d"]) - 1)
        more = (less.cast("decimal(20,0)") + 1).cast("decimal(20,0)").cast("string")
        options = [F.struct(F.rtrim(d, F.lit("0")).alias("d"), (x["p"] + F.length(d) - F.length(less)).alias("p"), (x["p"] - F.length(less)).alias("e"), d.alias("n")) for d in (less, more)]
        same = [F.concat(o["n"], F.lit("E"), o["e"]).cast("double") == F.abs(value) for o in options]
        back = [F.struct(o["d"].alias("d"), o["p"].alias("p")) for o in options]
        up = F.right(x["d"], F.lit(1)) >= "5"
        return F.when(F.length(x["d"]) < 2, x).when(same[1] & (up | ~same[0]), back[1]).when(same[0], back[0]).otherwise(x)

    def shown(x: Column) -> Column:
        d, p, n = x["d"], x["p"], F.length(x["d"])
        power = F.concat(F.when(p < 1, "e-").otherwise("e+"), F.lpad(F.abs(p - 1).cast("string"), F.greatest(F.lit(2), F.length(F.abs(p - 1).cast("string"))), F.lit("0")))
        far = F.concat(F.left(d, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise(""), power)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -p), d)
        large = F.concat(d, F.repeat(F.lit("0"), p - n), F.lit(".0"))
        return F.when(d == "", "0.0").when((p < -3) | (p > 16), far).when(p < 1, small).when(p >= n, large).otherwise(F.concat(F.left(d, p), F.lit("."), F.substr(d, p + 1)))

    sign = F.when(F.startswith(value.cast("string"), F.lit("-")), "-").otherwise("")
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.concat(sign, let(let(let(cut(text), shorter), shorter), shown)))


def json_text(value: Column, kind: T.DataType) -> Column:
    """A value of any type as compact JSON: fields and keys sorted at all levels, null for what JSON has not."""
    match kind:
        case T.StructType():
            fields = [F.concat(json_string(F.lit(f.name)), F.lit(":"), json_text(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
            made = F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
        case T.MapType():
            name = (lambda k: json_string(k)) if isinstance(kind.keyType, T.StringType) else (lambda k: json_string(json_text(k, kind.keyType)))
            in_order = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
            made = F.concat(F.lit("{"), F.array_join(F.transform(in_order, lambda e: F.concat(name(e["key"]), F.lit(":"), json_text(e["value"], kind.valueType))), ","), F.lit("}"))
        case T.ArrayType():
            made = F.concat(F.lit("["), F.array_join(F.transform(value, lambda e: json_text(e, kind.elementType)), ","), F.lit("]"))
        case T.DoubleType():
            made = json_double(value)
        case T.FloatType():
            made = json_double(value.cast("string").cast("double"))
        case T.BooleanType() | T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType() | T.DecimalType():
            made = value.cast("string")
        case T.BinaryType():
            made = json_string(F.base64(value))
        case T.NullType():
            made = F.lit(None).cast("string")
        case _:
            made = json_string(value.cast("string"))
    return F.coalesce(made, F.lit("null"))


def canonical_json(df: DataFrame, *keys: str) -> DataFrame:
    """All other columns as one JSON text without blanks, the names sorted at all levels of structs, maps and arrays.

    Doubles have the fewest digits that give them back; numbers that JSON has not become
    null. Dates, times and other types are written as strings, bytes as base64. The 17th
    digit of a double that needs so many is the JVM's, which may be one off the nearest.
    """
    rest = sorted(c for c in df.columns if c not in keys)
    row = T.StructType([df.schema[c] for c in rest])
    return df.select(*keys, F.struct(*rest).alias("_row")).select(*keys, json_text(F.col("_row"), row).alias("json"))


def write_canonical_json(df: DataFrame, path: str, *keys: str) -> None:
    """A folder of JSON lines, one per row, in the order of the keys."""
    canonical_json(df, *keys).repartitionByRange(*keys).sortWithinPartitions(*keys).select("json").write.mode("overwrite").text(path)
