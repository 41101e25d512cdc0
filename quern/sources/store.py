"""Collections as immutable Parquet segments under a chain of manifests.

Each commit writes a new manifest and renames it to the next number; whoever
takes the number first has committed, and readers of an older one are not
disturbed. That is as safe as the file system's rename to a name not yet taken. All paths
go through Spark's file system layer, so the root may lie in any store that the
cluster reaches.
"""

from __future__ import annotations

import copy
import json
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import EngineError
from quern.functions.values import field as column


#: A manifest names every segment, so their number is kept down.
MOST_SEGMENTS = 64


@dataclass
class Segment:
    path: str
    rows: int
    types: dict[str, str]


@dataclass
class Collection:
    types: dict[str, str] = field(default_factory=lambda: {"id": "double"})
    segments: list[Segment] = field(default_factory=list)
    indexes: list[str] = field(default_factory=list)
    next_id: int = 1
    #: Path of the last statistics, if the collection was analyzed.
    stats: str | None = None

    @property
    def rows(self) -> int:
        return sum(s.rows for s in self.segments)

    def add(self, segment: Segment) -> None:
        """A field that comes with a second type holds variants from then on."""
        for name, kind in segment.types.items():
            if self.types.setdefault(name, kind) != kind:
                self.types[name] = "variant"
        if segment.rows:
            self.segments.append(segment)


@dataclass
class State:
    version: int = 0
    collections: dict[str, Collection] = field(default_factory=dict)
    #: (collection, path of the ids that this commit changed; None for the whole collection)
    touched: list[tuple[str, str | None]] = field(default_factory=list)

    def draft(self) -> State:
        return State(self.version, copy.deepcopy(self.collections), [])


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Files.

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int):
        return self._path("_manifests", f"{version:020d}.json")

    def head(self) -> int:
        files, folder = self._files(), self._path("_manifests")
        if not files.exists(folder):
            return 0
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        return max((int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit()), default=0)

    def read(self, version: int | None = None) -> State:
        """The state at a version; the latest by default."""
        version = self.head() if version is None else version
        if not version:
            return State()
        stream = self._files().open(self._manifest(version))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        raw = json.loads(text)
        made = {n: Collection(c["types"], [Segment(**s) for s in c["segments"]], c["indexes"], c["next_id"], c["stats"]) for n, c in raw["collections"].items()}
        return State(version, made, [tuple(x) for x in raw["touched"]])

    def publish(self, state: State) -> State:
        """Commit a draft as the version after its own, if nobody else has."""
        text = json.dumps({"collections": {n: asdict(c) for n, c in state.collections.items()}, "touched": state.touched})
        jvm, files, draft = self.spark._jvm, self._files(), self._path("_manifests", f".draft-{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs = jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:  # a rename that fails where the number is taken; whoever reads it finds it whole
            context.rename(files.makeQualified(draft), files.makeQualified(self._manifest(state.version + 1)), self.spark._sc._gateway.new_array(fs.Options.Rename, 0))
        except Py4JJavaError as e:
            files.delete(draft, False)
            if "AlreadyExists" in str(e.java_exception) or self.head() > state.version:
                raise EngineError("WRITE_CONFLICT", "another commit came first") from e
            raise
        return State(state.version + 1, state.collections, state.touched)

    # Rows.

    def write(self, df: DataFrame, indexes: list[str] | None = None) -> Segment:
        """A new segment; the rows are counted while they are written.

        Indexed fields get a Bloom filter in each row group, and rows are
        ordered by the first of them within a file, so that readers skip more.
        """
        path, seen = f"{self.root}/seg-{uuid.uuid4().hex}", Observation()
        indexed = [i for i in indexes or [] if "." not in i and i in df.columns and df.schema[i].dataType.simpleString() in ("double", "string")]
        if indexed:
            df = df.sortWithinPartitions(column(indexed[0]))
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
        for i in indexed:
            writer = writer.option(f"parquet.bloom.filter.enabled#{i}", "true")
        writer.parquet(path)
        return Segment(path, seen.get["rows"], {f.name: f.dataType.simpleString() for f in df.schema.fields})

    def remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def write_ids(self, ids: DataFrame) -> str:
        path = f"{self.root}/ids-{uuid.uuid4().hex}"
        ids.write.parquet(path)
        return path

    def frame(self, c: Collection, segments: list[Segment] | None = None) -> DataFrame:
        """All rows of a collection, or of some of its segments."""
        segments = c.segments if segments is None else segments
        whole = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in c.types.items()])
        if not segments:
            return self.spark.createDataFrame([], whole)
        alike: dict[tuple, list[Segment]] = {}
        for s in segments:
            other = tuple(sorted((n, t) for n, t in s.types.items() if c.types[n] != t))
            alike.setdefault(other, []).append(s)
        parts = []
        for other, some in alike.items():
            kinds = dict(other)
            stored = T.StructType([T.StructField(n, T._parse_datatype_string(kinds.get(n, t))) for n, t in c.types.items()])
            df = self.spark.read.schema(stored).parquet(*[s.path for s in some])
            parts.append(df.select(*[column(n).cast("variant").alias(n) if n in kinds else column(n) for n in c.types]))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def touched_segments(self, c: Collection, where) -> tuple[dict[str, int], DataFrame]:
        """Matching rows of each segment that has some, and the matching rows' ids."""
        hit = self.frame(c).where(where) if where is not None else self.frame(c)
        name = F.regexp_extract(F.input_file_name(), r"seg-([0-9a-f]{32})", 1)
        found = hit.groupBy(name.alias("segment")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a segment at most
        return {r["segment"]: r["n"] for r in found}, hit.select("id")

    def tidy(self, c: Collection) -> None:
        """Many small inserts leave many segments: beyond ``MOST_SEGMENTS`` the smaller half becomes one."""
        if len(c.segments) > MOST_SEGMENTS:
            small = sorted(c.segments, key=lambda s: s.rows)[: len(c.segments) // 2]
            segment = self.write(self.frame(c, small), c.indexes)
            c.segments = [s for s in c.segments if s not in small]
            c.add(segment)

    def compact(self, c: Collection) -> Collection:
        """The same rows in one segment."""
        out = Collection(dict(c.types), [], list(c.indexes), c.next_id, c.stats)
        if c.segments:
            out.add(self.write(self.frame(c), c.indexes))
        return out

    def export(self, root: str) -> Store:
        """A snapshot: the latest state alone, in a store of its own."""
        other, state = Store(self.spark, root), State()
        for name, c in self.read().collections.items():
            made = Collection(dict(c.types), [], list(c.indexes), c.next_id)
            if c.segments:
                made.add(other.write(self.frame(c), c.indexes))
            state.collections[name] = made
        other.publish(state)
        return other

    def vacuum(self, horizon: int | None = None) -> dict[str, int]:
        """Forget the versions before ``horizon`` (the latest) and files that only they name.

        Readers and transactions of older versions must have ended.
        """
        head = self.head()
        horizon = head if horizon is None else min(horizon, head)
        files, kept = self._files(), set()
        versions = [v for v in range(1, head + 1) if files.exists(self._manifest(v))]
        for v in versions:
            if v >= horizon:
                state = self.read(v)
                kept |= {s.path.rsplit("/", 1)[1] for c in state.collections.values() for s in c.segments}
                kept |= {p.rsplit("/", 1)[1] for p in [*(c.stats for c in state.collections.values()), *(p for _, p in state.touched)] if p}
        counts = {"versions": 0, "files": 0}
        for v in versions:
            if v < horizon:
                files.delete(self._manifest(v), False)
                counts["versions"] += 1
        for f in files.listStatus(self._path()):
            name = f.getPath().getName()
            if name.startswith(("seg-", "ids-", "stats-", "load-")) and name not in kept:
                files.delete(f.getPath(), True)
                counts["files"] += 1
        return counts
