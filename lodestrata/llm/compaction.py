"""Executed compaction: small files of a folder are packed by runs of equal sizes, and merged.

A group of files (such as a day) is packed first fit, in descending order of rows. Files of equal size are not
placed one by one: they are one size with a multiplicity, and the earliest open bin takes
``floor(residual / size)`` of them at once, the next one what is left, and so on. So the packing works on
distinct sizes and bins, its answer is a range of ordinals for each bin and size, and the ranges are expanded
to files by a join.

A folder of parts has one Parquet file a part below ``key=value`` directories. The merged file of a bin takes the
place of its first part; the other parts of the bin go. Rows never leave Spark: each bin is read, put in the order
of its parts and written by one task that sorts on disk where it must, because the file is demanded whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 100_000  # rows of a table of parts or days that may be broadcast, after they are counted


def bounded(df: DataFrame) -> DataFrame:
    """A stored table, broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def pack_runs(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """First fit of ``counts`` files of each of the descending ``sizes``: (bin, size, first ordinal, files), bins from 0 as they open.

    A file above the capacity opens a bin of its own. A bin without room for the smallest size is no longer visited.
    """
    out, opened, least = [], 0, min(sizes, default=0)
    open_bins: list[tuple[int, int]] = []  # bin, room
    for size, many in zip(sizes, counts, strict=True):
        at, still = 0, []
        for number, room in open_bins:
            take = min(many - at, room // size) if size else many - at
            if take:
                out.append((number, size, at, take))
                at, room = at + take, room - take * size
            if room >= least:
                still.append((number, room))
        each = max(1, capacity // size) if size else many
        while at < many:
            take = min(many - at, each)
            out.append((opened, size, at, take))
            if capacity - take * size >= least:
                still.append((opened, capacity - take * size))
            at, opened = at + take, opened + 1
        open_bins = still
    return out


def plan_bins(parts: DataFrame, group: str, order: list[str], small: int, capacity: int) -> DataFrame:
    """(group, *order, n_rows, bin, place): the parts that a merge concerns, by bin, in joining order (from 1).

    ``parts`` has the group, the columns of ``order`` (which break ties of n_rows) and n_rows; a null group is a group.
    Parts of ``small`` rows and more stay out, and so do bins of one part: both are files that stay. Groups are packed
    apart, each by one task that holds its distinct sizes and its bins, not its parts.
    """
    light = parts.filter(F.col("n_rows") < small).select(group, *order, "n_rows")
    runs = light.groupBy(group, "n_rows").agg(F.count("*").alias("many"))
    kind = dict(parts.dtypes)[group]

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n_rows", ascending=False)
        made = pd.DataFrame(pack_runs(frame["n_rows"].tolist(), frame["many"].tolist(), capacity), columns=["bin", "n_rows", "first", "taken"], dtype="int64")
        made.insert(0, group, pd.Series([key[0]] * len(made), index=made.index, dtype=frame[group].dtype))
        return made

    ranges = runs.groupBy(group).applyInPandas(pack, f"{group} {kind}, bin long, n_rows long, first long, taken long")
    ordinal = F.row_number().over(Window.partitionBy(group, "n_rows").orderBy(*[F.col(c).asc_nulls_first() for c in order])) - 1
    r = ranges.select(F.col(group).alias("_g"), F.col("n_rows").alias("_n"), "bin", "first", "taken")
    placed = light.withColumn("ordinal", ordinal).join(r, F.col(group).eqNullSafe(F.col("_g")) & (F.col("n_rows") == F.col("_n")) & (F.col("ordinal") >= F.col("first")) & (F.col("ordinal") < F.col("first") + F.col("taken")))
    # Within a bin parts join in descending order of size, equal sizes by their ordinals.
    of_bin = Window.partitionBy(group, "bin")
    joined = placed.withColumn("place", F.row_number().over(of_bin.orderBy(F.col("n_rows").desc(), "ordinal"))).withColumn("many", F.count("*").over(of_bin))
    return joined.filter("many > 1").select(group, *order, "n_rows", "bin", "place")


@dataclass
class Parts:
    """A folder of parts: one file for each value of the ``keys``, with the columns of ``schema``, sorted by ``order``."""

    path: str
    keys: list[str]
    schema: T.StructType
    order: list[str]
    key_types: list[T.DataType]

    def read(self, spark, path: str | None = None, keys: list[str] | None = None) -> DataFrame:
        """The rows, with the keys from the names of directories."""
        types = dict(zip(self.keys, self.key_types, strict=True))
        fields = [T.StructField(k, types.get(k, T.LongType())) for k in keys or self.keys]
        return spark.read.schema(T.StructType([*self.schema.fields, *fields])).parquet(path or self.path)

    def sorting(self) -> list[Column]:
        """A total order of rows within a part: the stated columns, then all others that can be ordered."""
        rest = [f.name for f in self.schema.fields if f.name not in self.order and not _holds_map(f.dataType)]
        return [F.col(f"`{c}`").asc_nulls_first() for c in [*self.order, *rest]]


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType)) or (isinstance(kind, T.ArrayType) and _holds_map(kind.elementType))


def free_names(wanted: list[str], taken: list[str]) -> list[str]:
    """The names, each with underscores before it until no column of that name is there."""
    low, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in low:
            name = f"_{name}"
        low.add(name.lower())
        out.append(name)
    return out


def write_parts(df: DataFrame, path: str, keys: dict[str, Column], order: list[str], columns: list[str] | None = None) -> Parts:
    """Write ``df`` as one file for each value of ``keys`` (expressions of long or int), rows by ``order``, nulls first.

    ``columns`` (all of ``df``) go into the files, in their order; a key whose name a column has is renamed for the directories.
    """
    columns = columns or df.columns
    names = free_names(list(keys), columns)
    keyed = df.select(*[f"`{c}`" for c in columns], *[e.alias(n) for n, e in zip(names, keys.values(), strict=True)])
    parts = Parts(path, names, T.StructType(keyed.schema.fields[: len(columns)]), order, [keyed.schema[n].dataType for n in names])
    by_key = [F.col(n) for n in names]
    keyed.repartition(*by_key).sortWithinPartitions(*by_key, *parts.sorting()).write.partitionBy(*names).parquet(path)
    return parts


def part_rows(spark, parts: Parts) -> DataFrame:
    """(*keys, n_rows) of the files that are there: a read without columns."""
    return parts.read(spark).groupBy(*parts.keys).agg(F.count("*").alias("n_rows"))


class Folder:
    """The few moves in a folder that Spark's writers do not make."""

    def __init__(self, spark, path: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def there(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def files(self, path: str) -> list[str]:
        """Data files of one directory."""
        found = self.fs.listStatus(self._path(path)) if self.there(path) else []
        return [s.getPath().toString() for s in found if s.getPath().getName().endswith(".parquet")]

    def remove(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def move(self, old: str, new: str) -> None:
        self.fs.mkdirs(self._path(new).getParent())
        if not self.fs.rename(self._path(old), self._path(new)):
            raise OSError(f"cannot move {old} to {new}")


def _directory(keys: list[str], values) -> str:
    return "/".join(f"{k}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for k, v in zip(keys, values, strict=True))


def merge_bins(spark, parts: Parts, plan: DataFrame) -> None:
    """Replace the parts of each bin of a stored ``plan`` (see ``plan_bins``) by one file with their rows in joining order.

    All merged files are written beside the folder first; then, part by part, what was merged goes, and the merged file
    takes the place of the first part. A call after a crash goes on where the swap stood, and one after the end does
    nothing: a merged file is either still beside, or in its place. The names of the parts of bins pass by one at
    a time, as they do in Spark's own listing of files; rows do not.
    """
    folder, group = Folder(spark, parts.path), parts.keys[0]
    staged = f"{parts.path.rstrip('/')}.merged"
    at = lambda row: f"{parts.path.rstrip('/')}/{_directory(parts.keys, [row[k] for k in parts.keys])}"
    bin_no, place = free_names(["bin", "place"], [*parts.schema.names, *parts.keys])
    if not folder.there(f"{staged}/_SUCCESS"):
        second = plan.filter("place = 2").first()
        if second is None or not folder.there(at(second)):
            return
        named = plan.select(*[F.col(k).alias(f"_k{i}_") for i, k in enumerate(parts.keys)], F.col("bin").alias(bin_no), F.col("place").alias(place))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}_")) for i, k in enumerate(parts.keys)]
        rows = parts.read(spark).join(bounded(named), same).select(*[f"`{c}`" for c in parts.schema.names], group, bin_no, place)
        by_bin = [F.col(group), F.col(bin_no)]
        ordered = rows.repartition(*by_bin).sortWithinPartitions(*by_bin, place, *parts.sorting())
        ordered.drop(place).write.mode("overwrite").partitionBy(group, bin_no).parquet(staged)
    for row in plan.select(*parts.keys, "bin", "place").toLocalIterator():
        if row["place"] > 1:
            folder.remove(at(row))
            continue
        for merged in folder.files(f"{staged}/{_directory([group, bin_no], [row[group], row['bin']])}"):
            folder.remove(at(row))
            folder.move(merged, f"{at(row)}/{merged.rsplit('/', 1)[1]}")
    folder.remove(staged)


_STREAMED = "path string, n_rows long, min_id long, max_id long, total long, ids_sha256 string"


def digests(rows: DataFrame) -> DataFrame:
    """One row a file of ``rows`` (path, row_no, id, amount): count, least and greatest id, sum, digest of the ids in file order.

    The digest is the SHA-256 of the decimal ids joined by commas, a null id being empty. It is sequential by definition,
    so the rows of a file are sorted by their number and stream through one task, a batch at a time.
    """
    streamed = rows.select("path", "row_no", "id", "amount").repartition("path").sortWithinPartitions("path", "row_no").select("path", "id", "amount")

    def run(batches):
        now, state, n, total, least, most = None, None, 0, 0, None, None

        def row():
            return pa.RecordBatch.from_pydict({
                "path": [now], "n_rows": pa.array([n], pa.int64()), "min_id": pa.array([least], pa.int64()), "max_id": pa.array([most], pa.int64()),
                "total": pa.array([total], pa.int64()), "ids_sha256": [state.hexdigest()],
            })

        for batch in batches:
            paths = batch.column(0).dictionary_encode()
            codes = np.asarray(paths.indices)
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                path = paths.dictionary[int(codes[lo])].as_py()
                if path != now:
                    if now is not None:
                        yield row()
                    now, state, n, total, least, most = path, hashlib.sha256(), 0, 0, None, None
                ids = batch.column(1).slice(lo, hi - lo)
                text = ",".join("" if x is None else str(x) for x in ids.to_pylist())
                state.update((("," if n else "") + text).encode())
                n += hi - lo
                total += sum(x for x in batch.column(2).slice(lo, hi - lo).to_pylist() if x is not None)
                known = ids.drop_null().to_numpy()
                if len(known):
                    low, high = int(known.min()), int(known.max())
                    least, most = low if least is None else min(least, low), high if most is None else max(most, high)
        if now is not None:
            yield row()

    return streamed.mapInArrow(run, _STREAMED)


_RESULT = (
    "day long, lot long, piece long, n_rows long, min_click_id long, max_click_id long, cents long, "
    "sources string, ids_sha256 string, columns string, path string, rewritten boolean"
)


def compact_clicks(spark, clicks: DataFrame, path: str, keep) -> DataFrame:
    """Write ``clicks`` (click_id, arrived_at, value, ...) as parts by day, lot and piece, compact them, describe the final files.

    ``keep`` stores small tables. With R rows and S(x) = 1 + floor(R / x), parts under S(600) rows are packed into bins of
    S(400) rows; there are at most 4 * (days + 150) parts, however many rows. A null arrived_at is a day of its own (null), a
    null click_id is an empty text for lot, piece and digest and no least or greatest id; a value that is null or not finite
    is 0 cents. Repeated rows stay; rows that tie in arrived_at and click_id are ordered by their other columns. Very long
    and empty texts are values like others, and other columns go into the files whatever their names. An empty table
    leaves no file and gives no row.
    """
    day = F.unix_date(F.col("arrived_at").cast("date")).cast("long")
    by_day = keep(clicks.select(day.alias("day")).groupBy("day").agg(F.count("*").alias("r")), "days")
    rows = by_day.agg(F.sum("r")).first()[0] or 0
    if not rows:
        return spark.createDataFrame([], _RESULT)
    share = lambda x: 1 + rows // x
    day_of, lots_of = free_names(["_day", "_lots"], clicks.columns)
    lots = by_day.select(F.col("day").alias(day_of), (1 + F.floor(F.col("r") / share(150))).cast("long").alias(lots_of))
    h = F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary"))
    keys = {"day": F.col(day_of), "lot": F.shiftright(h, 4) % F.col(lots_of), "piece": F.least(h % 4, F.shiftright(h, 2) % 4)}
    dealt = clicks.join(bounded(lots), day.eqNullSafe(F.col(day_of)))
    parts = write_parts(dealt, path, keys, ["arrived_at", "click_id"], clicks.columns)
    plan = keep(plan_bins(keep(part_rows(spark, parts), "parts"), parts.keys[0], parts.keys[1:], share(600), share(400)), "plan")
    merge_bins(spark, parts, plan)

    files = parts.read(spark)
    meta, value = files.metadataColumn("_metadata"), F.col("value").cast("double")
    cents = F.when(F.abs(value) < float("inf"), F.floor(100 * value + 0.5).cast("long")).otherwise(0)
    in_files = files.select(meta["file_path"].alias("path"), meta["row_index"].alias("row_no"), F.col("click_id").cast("long").alias("id"), cents.alias("amount"), *[F.col(k).alias(f"_k{i}_") for i, k in enumerate(parts.keys)])
    told = digests(in_files)
    placed = in_files.groupBy("path").agg(*[F.max(f"_k{i}_").alias(f"_k{i}_") for i in range(3)])
    source = F.concat_ws("-", parts.keys[1], parts.keys[2])
    bins = plan.groupBy(parts.keys[0], "bin").agg(
        F.min_by(F.struct(*parts.keys), "place").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", source.alias("source")))), lambda x: x["source"]), ",").alias("sources"),
    )
    described = told.join(placed, "path").join(bins, [F.col(f"_k{i}_").eqNullSafe(F.col("first")[k]) for i, k in enumerate(parts.keys)], "left")
    return described.select(
        F.col("_k0_").alias("day"), F.col("_k1_").alias("lot"), F.col("_k2_").alias("piece"),
        "n_rows", F.col("min_id").alias("min_click_id"), F.col("max_id").alias("max_click_id"), F.col("total").alias("cents"),
        F.coalesce("sources", F.concat_ws("-", "_k1_", "_k2_")).alias("sources"), "ids_sha256",
        F.lit(",".join(parts.schema.names)).alias("columns"), "path", F.col("sources").isNotNull().alias("rewritten"),
    )
