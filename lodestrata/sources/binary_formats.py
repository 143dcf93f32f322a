"""Binary captures: GeoPackage blobs and tables, WKB, ZIP members, HTML links and literal dictionaries.

Bytes that no built-in function reads pass through Python in Arrow batches; each function keeps the rows
that it cannot read, with a reason.
"""

from __future__ import annotations

import ast
import io
import sqlite3
import struct
import tempfile
import zipfile
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}  # fixed values of the GeoPackage binary header
GEOMETRY = T.StructType([T.StructField("srid", T.IntegerType()), T.StructField("wkb", T.BinaryType()), T.StructField("hold", T.StringType())])


def split_geopackage(blob: bytes | None) -> tuple[int | None, bytes | None, str | None]:
    """(srid, wkb, hold) of a GeoPackage geometry blob."""
    if blob is None:
        return None, None, "missing"
    if len(blob) < 8 or blob[:2] != b"GP":
        return None, None, "bad header"
    flags = blob[3]
    extent = ENVELOPE_BYTES.get((flags >> 1) & 7)
    if extent is None:
        return None, None, "bad envelope"
    srid = struct.unpack("<i" if flags & 1 else ">i", blob[4:8])[0]
    if flags & 16:
        return srid, None, "empty"
    return srid, blob[8 + extent :], None


@F.pandas_udf(GEOMETRY)
def geopackage_geometry(blobs: pd.Series) -> pd.DataFrame:
    """Header, envelope and WKB of GeoPackage blobs."""
    return pd.DataFrame([split_geopackage(None if b is None else bytes(b)) for b in blobs], columns=["srid", "wkb", "hold"])


def wkb_rings(wkb: bytes) -> list[list[list[list[float]]]]:
    """Polygons of a WKB Polygon or MultiPolygon: polygons of rings of points. Other types are an error."""

    def read(at: int) -> tuple[list, int]:
        order = "<" if wkb[at] == 1 else ">"
        kind, count = struct.unpack_from(order + "II", wkb, at + 1)
        at += 9
        if kind == 3:
            rings = []
            for _ in range(count):
                (n,) = struct.unpack_from(order + "I", wkb, at)
                flat = struct.unpack_from(f"{order}{2 * n}d", wkb, at + 4)
                at += 4 + 16 * n
                rings.append([list(p) for p in zip(flat[::2], flat[1::2], strict=True)])
            return [rings], at
        if kind == 6:
            out = []
            for _ in range(count):
                part, at = read(at)
                out += part
            return out, at
        raise ValueError("only polygons are read")

    return read(0)[0]


def polygon_wkb(rings: list[list[list[float]]]) -> bytes:
    """Little-endian WKB of one polygon."""
    out = [struct.pack("<BII", 1, 3, len(rings))]
    for ring in rings:
        out.append(struct.pack(f"<I{2 * len(ring)}d", len(ring), *[v for p in ring for v in p]))
    return b"".join(out)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))))
def decoded_wkb(blobs: pd.Series) -> pd.Series:
    """Polygons of WKB; null where it does not decode."""

    def one(b):
        try:
            return None if b is None else wkb_rings(bytes(b))
        except (ValueError, struct.error, IndexError):
            return None

    return blobs.map(one)


def sqlite_rows(files: DataFrame, table: str, columns: list[str], schema: str, where: str = "") -> DataFrame:
    """Rows of a table in SQLite (GeoPackage) files (path, content), filtered inside SQLite by ``where``."""
    names = ", ".join(f'"{c}"' for c in columns)
    query = f'select {names} from "{table}"' + (f" where {where}" if where else "")

    def run(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with tempfile.NamedTemporaryFile(suffix=".sqlite") as held:  # read at once by this task, nothing is kept
                    held.write(bytes(content))
                    held.flush()
                    con = sqlite3.connect(f"file:{held.name}?mode=ro", uri=True)
                    try:
                        rows = con.execute(query)
                        while part := rows.fetchmany(5000):
                            yield pd.DataFrame([(path, *r) for r in part], columns=["path", *columns])
                    finally:
                        con.close()

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def zip_members(files: DataFrame, suffix: str = "") -> DataFrame:
    """(path, member, content) of ZIP archives."""

    def run(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for info in z.infolist():
                        if not info.is_dir() and info.filename.endswith(suffix):
                            yield pd.DataFrame({"path": [path], "member": [info.filename], "content": [z.read(info)]})

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary")


class _Links(HTMLParser):
    def __init__(self, page: str):
        super().__init__()
        self.base, self.found = page, []

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "base" and named.get("href"):
            self.base = urljoin(self.base, named["href"])
        if tag == "a" and named.get("href"):
            self.found.append(urljoin(self.base, named["href"].strip()))


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_links(urls: pd.Series, html: pd.Series) -> pd.Series:
    """Absolute links of raw pages, with regard to <base>."""

    def one(url, text):
        if text is None:
            return []
        parser = _Links(url or "")
        try:
            parser.feed(text)
        except ValueError:
            pass
        return parser.found

    return pd.Series([one(u, t) for u, t in zip(urls, html, strict=True)])


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def literal_dictionary(sources: pd.Series) -> pd.Series:
    """Top-level dictionaries of string keys and plain values in a Python source, without running it."""

    def one(text):
        out = {}
        try:
            tree = ast.parse(text or "")
        except SyntaxError:
            return out
        for node in tree.body:
            if isinstance(node, ast.Assign) and isinstance(node.value, ast.Dict):
                try:
                    value = ast.literal_eval(node.value)
                except ValueError:
                    continue
                out |= {str(k): str(v) for k, v in value.items()}
        return out

    return sources.map(one)
