"""Stored frames that are replaced without a hole: generations of files, and a pointer that names the current ones.

Below the path of a frame every write makes a folder ``gen=<number>`` of its own.  ``_current.json`` names the
generation of each partition folder, the generations laid over them, and what is no longer needed.  It is flipped by
one rename after all files are complete.  So a write that fails leaves the old rows, and a reader keeps the version it
has opened: files go only with the second write after the one that replaced them.  One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from operator import and_, or_
from uuid import uuid4

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, types as T
from pyspark.sql import functions as F

POINTER = "_current.json"

Save = Callable[[DataFrame, str], None]
Load = Callable[[DataFrameReader, list[str]], DataFrame]


@dataclass
class Version:
    """``parts``: generation of each partition folder ('' in a frame without partitions).  ``layers``: generations laid
    over them, oldest first, each with the columns by which its rows replace older ones; without any they only add.
    ``whole``: the generation up to which rows lie in the folders alone.  ``notes``: what a job wants to know about the
    version it wrote, flipped with it."""

    last: int = 0
    parts: dict[str, int] = field(default_factory=dict)
    layers: list[tuple[int, list[str]]] = field(default_factory=list)
    retired: list[str] = field(default_factory=list)
    whole: int = 0
    notes: dict[str, str | int] = field(default_factory=dict)


def _with_gen(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("gen", T.IntegerType())])


def _parquet(reader: DataFrameReader, paths: list[str]) -> DataFrame:
    return reader.parquet(*paths)


class Versioned:
    """One stored frame: ``partitions`` are its folder columns."""

    def __init__(self, spark: SparkSession, path: str, partitions: tuple[str, ...] | list[str] = ()):
        self.spark, self.path, self.partitions = spark, path.rstrip("/"), list(partitions)
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    # -- files ---------------------------------------------------------------

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _folder(self, generation: int) -> str:
        return f"{self.path}/gen={generation:06d}"

    def _folders(self, generation: int) -> list[str]:
        """Partition folders of a generation, as many as the layout has."""
        found = [f"gen={generation:06d}"]
        for _ in self.partitions:
            found = [f"{parent}/{s.getPath().getName()}" for parent in found
                     for s in self._fs.listStatus(self._at(parent)) if s.isDirectory()]
        return [name.partition("/")[2] for name in found]

    def version(self) -> Version | None:
        """What the pointer says; none for a plain folder or none at all."""
        if not self._fs.exists(self._at(POINTER)):
            return None
        stream = self._fs.open(self._at(POINTER))
        try:
            data = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(**data | {"layers": [(g, k) for g, k in data["layers"]]})

    def _flip(self, version: Version, before: Version, retired: list[str]) -> None:
        version.retired = retired
        aside = self._at(f"{POINTER}.{uuid4().hex}")
        stream = self._fs.create(aside, True)
        try:
            stream.write(json.dumps(asdict(version)).encode())
        finally:
            stream.close()
        rename = self._hadoop.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._hadoop.FileContext.getFileContext(aside.toUri(), self._conf).rename(aside, self._at(POINTER), options)
        for name in before.retired:
            self._fs.delete(self._at(name), True)

    # -- writing -------------------------------------------------------------

    def write(self, df: DataFrame, save: Save) -> int:
        """Write a generation that nobody reads yet.  What a failed write left of it is overwritten."""
        generation = (self.version() or Version()).last + 1
        save(df, self._folder(generation))
        return generation

    def holds_rows(self, generation: int) -> bool:
        """Whether a written generation of a frame with partitions has any folder: empty ones are not made."""
        return bool(self._folders(generation))

    def discard(self, generation: int) -> None:
        self._fs.delete(self._at(f"gen={generation:06d}"), True)

    def replace(self, generation: int, only_touched: bool = False, **notes: str | int) -> None:
        """Make a written generation the current one, whole or in the partition folders it has."""
        before = self.version() or Version()
        if only_touched and before.layers:
            raise ValueError(f"fold the layers over {self.path} before single folders are replaced")
        new = {part: generation for part in self._folders(generation)}
        kept = before.parts if only_touched else {}
        gone = [f"gen={g:06d}/{part}" if part else f"gen={g:06d}" for part, g in before.parts.items()
                if part in new or not only_touched]
        gone += [f"gen={g:06d}" for g, _ in before.layers]
        self._flip(Version(generation, {**kept, **new}, whole=generation, notes=notes), before, gone)

    def lay_over(self, generation: int, key: list[str], **notes: str | int) -> None:
        """Lay a written generation over the others: its rows replace older ones of the same ``key`` (nulls are equal)."""
        before = self.version() or Version()
        layers = [*before.layers, (generation, key)]
        self._flip(Version(generation, before.parts, layers, whole=before.whole, notes=before.notes | notes), before, [])

    def note(self, **notes: str | int) -> None:
        before = self.version() or Version()
        self._flip(replace(before, notes=before.notes | notes), before, [])

    def layers_after(self, generation: int, schema: T.StructType) -> DataFrame | None:
        """Rows of the layers newer than a generation, with columns that only layers may have, and ``gen``.

        None if the frame has been rewritten since, so that its layers don't tell all that changed.
        """
        version = self.version()
        if version is None or version.whole > generation:
            return None
        newer = [(g, key) for g, key in version.layers if g > generation]
        if not newer:
            return self.spark.createDataFrame([], _with_gen(schema))
        return self._layers(replace(version, layers=newer), schema)

    def fold(self, schema: T.StructType, save: Save) -> int:
        """Write the partition folders that layers touch anew and drop the layers; returns how many those are."""
        before = self.version()
        if before is None or not before.layers:
            return 0
        rows = self.read(schema)
        if self.partitions:
            rows = rows.filter(touching(self._layers(before, schema), self.partitions))
        generation = self.write(rows, save)
        new = {part: generation for part in self._folders(generation)}
        gone = [f"gen={g:06d}/{part}" if part else f"gen={g:06d}" for part, g in before.parts.items() if part in new]
        gone += [f"gen={g:06d}" for g, _ in before.layers]
        self._flip(Version(generation, {**before.parts, **new}, whole=before.last, notes=before.notes), before, gone)
        return len(new)

    # -- reading -------------------------------------------------------------

    def _open(self, folders: list[str], schema: T.StructType, load: Load = _parquet) -> DataFrame:
        reader = self.spark.read.schema(schema).option("basePath", self.path)
        return load(reader, folders)

    def _layers(self, version: Version, schema: T.StructType) -> DataFrame:
        """Rows of all layers, with the number of their generation as ``gen``."""
        return self._open([self._folder(g) for g, _ in version.layers], _with_gen(schema))

    def read(self, schema: T.StructType, load: Load = _parquet) -> DataFrame:
        """The current rows.  A folder without a pointer is read as it is."""
        names = schema.fieldNames()
        version = self.version()
        if version is None:
            return load(self.spark.read.schema(schema), [self.path])
        generations = set(version.parts.values())
        if len(generations) == 1 and len(version.parts) == len(self._folders(*generations)):
            folders = [self._folder(*generations)]
        else:
            folders = [f"{self._folder(g)}/{part}" for part, g in sorted(version.parts.items())]
        if not version.layers:
            return self._open(folders, schema, load).select(*names) if folders else self.spark.createDataFrame([], schema)
        over = self._layers(version, schema)
        keyed = {g: key for g, key in version.layers if key}
        # nothing lies over the rows of the last keyed layer and those added since: they meet no keys
        last = max(keyed, default=0)
        top = self._open([self._folder(g) for g, _ in version.layers if g >= last], over.schema).select(*names)
        folders += [self._folder(g) for g, _ in version.layers if g < last]
        if not keyed or not folders:
            return self._open(folders, over.schema).select(*names).unionByName(top) if folders else top
        rows = self._open(folders, over.schema)
        key = next(iter(keyed.values()))
        # the oldest rows replace none
        oldest = min([*version.parts.values(), *(g for g, _ in version.layers)])
        newest = (over.filter(F.col("gen").isin([g for g in keyed if g > oldest])).groupBy(*key).agg(F.max("gen").alias("_newest"))
                  .select(*[F.col(c).alias(f"_key_{c}") for c in key], "_newest"))
        same = reduce(and_, [rows[c].eqNullSafe(newest[f"_key_{c}"]) for c in key])
        below = rows.join(newest, same, "left").filter(F.col("_newest").isNull() | (F.col("gen") >= F.col("_newest")))
        return below.select(*names).unionByName(top)


def touching(df: DataFrame, columns: list[str]) -> Column:
    """The values that some columns take in a frame, as a filter that a scan can prune folders by.

    Nulls have a folder of their own.  To the driver come as many rows as there are folders.
    """
    found = df.select(*columns).distinct().collect()
    groups: dict[tuple, set] = {}
    for *front, last in found:
        groups.setdefault(tuple(front), set()).add(last)
    chosen = []
    for front, lasts in groups.items():
        test = F.col(columns[-1]).isin(sorted(lasts - {None}))
        if None in lasts:
            test = test | F.col(columns[-1]).isNull()
        for name, value in zip(columns[:-1], front, strict=True):
            test = test & (F.col(name).isNull() if value is None else F.col(name) == value)
        chosen.append(test)
    return reduce(or_, chosen, F.lit(False))
