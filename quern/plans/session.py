"""Statements to results: reads are lazy DataFrames, writes are commits.

Outside a transaction each write commits by itself, and is done again on the
new state if another writer came first. A transaction works on a draft that
only its own session sees; at commit, if others committed meanwhile, a document
that both changed is a WRITE_CONFLICT (the first committer wins), else its
writes, imports and statistics are done again on the latest state. Abort
forgets the draft.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quern.errors import EngineError
from quern.operators import changes as C
from quern.operators import stats
from quern.sources import jsonl
from quern.sources.results import as_json, as_text
from quern.sources.store import Collection, Segment, State, Store

from .estimate import cheapest_first, share
from .lower import condition, rows
from .parser import parse
from .syntax import Both, Compare, Condition, Either, Exists, Member, Not, Query

_RETRIES = 5
#: What one manifest may hold.
MAX_COLLECTIONS, MAX_INDEXES = 65_536, 1_024


@dataclass
class Result:
    ok: bool = True
    info: str = ""
    df: DataFrame | None = None
    count: int = 0
    code: str = ""
    message: str = ""

    def json(self) -> str:
        return as_json(self)

    def text(self) -> str:
        return as_text(self)


@dataclass
class Draft:
    state: State
    #: What was done so far, to be done again on another state.
    steps: list[Callable[[State], object]] = field(default_factory=list)
    #: Staged imports, which go when the transaction ends.
    staged: list[str] = field(default_factory=list)


class Session:
    """``tables`` are read-only collections: name -> (DataFrame, field or fields that order it)."""

    def __init__(self, spark: SparkSession, root: str | None = None, tables: dict[str, tuple[DataFrame, str | tuple[str, ...]]] | None = None):
        self.spark, self.tables = spark, {} if tables is None else tables
        self.store = Store(spark, root) if root else None
        self.draft: Draft | None = None
        self.database = "default"
        self.mode = "cost"
        self.kept: dict[str, tuple[int, DataFrame]] = {}
        self._before: dict[str, str | None] = {}
        self._profiles: dict[str, dict[str, Row]] = {}

    def close(self) -> None:
        """Abort what is open, drop what is kept, and set the Spark session back."""
        if self.draft:
            self._end(self.draft)
            self.draft = None
        self._forget()
        for name, value in self._before.items():
            self.spark.conf.unset(name) if value is None else self.spark.conf.set(name, value)
        self._before.clear()

    # Reading.

    def state(self) -> State:
        if self.draft:
            return self.draft.state
        return self.store.read() if self.store else State()

    def find(self, name: str) -> tuple[DataFrame, str | tuple[str, ...]] | None:
        if name in self.tables:
            return self.tables[name]
        state = self.state()
        c = state.collections.get(name)
        if not c:
            return None
        version, df = self.kept.get(name, (None, None))
        return (df if version == state.version and not self.draft else self.store.frame(c)), "id"

    def frame(self, name: str) -> DataFrame:
        found = self.find(name)
        if not found:
            raise EngineError("NO_COLLECTION", f"collection '{name}' not found")
        return found[0]

    def keep(self, name: str) -> None:
        """Cache a collection's rows as long as nobody writes to the store."""
        if name in self.kept:
            self.kept.pop(name)[1].unpersist()
        self.kept[name] = (self.state().version, self.frame(name).persist())

    def _forget(self) -> None:
        for _, df in self.kept.values():
            df.unpersist()
        self.kept.clear()

    # Statements.

    def execute(self, statement: str) -> Result:
        try:
            return self.run(parse(statement))
        except EngineError as e:
            return Result(False, code=e.code, message=e.message)
        except PySparkException as e:  # a file that is gone, a store that refuses
            return Result(False, code="IO", message=str(e).splitlines()[0])

    def sql(self, statement: str) -> DataFrame:
        """The rows of a read, lazily; errors are raised."""
        return self.run(parse(statement)).df

    def run(self, q: Query) -> Result:
        do: dict[str, Callable[[Query], Result]] = {
            "funden": self._read,
            "gomail": self._read,
            "skill": self._skill,
            "exepanus": self._explain,
            "analyze": self._analyze,
            "usf": self._use,
            "ginan": self._begin,
            "cometi": self._commit,
            "tulaberk": self._abort,
        }
        return do[q.verb](q) if q.verb in do else self._write(q)

    def _read(self, q: Query) -> Result:
        if self.mode == "cost" and q.where is not None and (known := self._known(q.collection)):
            q = replace(q, where=cheapest_first(q.where, known))
        return Result(df=rows(q, self.frame(q.collection), self.find))

    def _known(self, name: str) -> dict[str, Row]:
        """The last statistics of a collection by field; read once."""
        c = self.state().collections.get(name) if name not in self.tables else None
        if not c or not c.stats:
            return {}
        if c.stats not in self._profiles:
            self._profiles[c.stats] = {r["field"]: r for r in self.spark.read.parquet(c.stats).collect()}
        return self._profiles[c.stats]

    def _skill(self, q: Query) -> Result:
        if q.collection:
            return Result(info=f"{q.collection}: {self.frame(q.collection).count() if q.collection in self.tables else self._collection(q).rows} documents")
        names = [*self.tables, *self.state().collections]
        return Result(info="collections: " + ", ".join(names), count=len(names))

    def _collection(self, q: Query, state: State | None = None) -> Collection:
        found = (state or self.state()).collections.get(q.collection)
        if not found:
            raise EngineError("NO_COLLECTION", f"collection '{q.collection}' not found")
        return found

    def _explain(self, q: Query) -> Result:
        inner = q.inner or Query("funden", q.collection, q.where)
        df = self.frame(inner.collection)
        if inner.verb in ("funden", "gomail"):
            df = rows(inner, df, self.find)
        elif inner.where is not None:
            df = df.filter(condition(df, inner.where))
        plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        c = self.state().collections.get(inner.collection)
        used = next((i for i in (c.indexes if c else ()) if i in fields(inner.where)), None)
        head = f"INDEX SCAN {inner.collection} (field: {used})" if used else f"SCAN {inner.collection}"
        known = self._known(inner.collection)
        if c and known:
            head += f"\nabout {share(inner.where, known) * c.rows:.0f} of {c.rows} documents"
        return Result(info=f"{head}\n{plan}")

    def _analyze(self, q: Query) -> Result:
        profile, done = stats.profile(self.frame(q.collection)), f"analyzed collection '{q.collection}'"
        if q.collection in self.tables:
            return Result(df=profile, info=done)
        path = f"{self.store.root}/stats-{uuid.uuid4().hex}"
        profile.write.parquet(path)

        def note(state: State) -> None:
            self._collection(q, state).stats = path

        self._commit_step(note)
        return Result(df=self.statistics(q.collection), info=done)

    def statistics(self, name: str) -> DataFrame | None:
        """What the last analyze of a collection found."""
        path = self._collection(Query("analyze", name)).stats
        return self.spark.read.parquet(path) if path else None

    def _use(self, q: Query) -> Result:
        self.database = q.collection
        return Result(info=f"using database {q.collection}")

    # Transactions.

    def _begin(self, q: Query) -> Result:
        if self.draft:
            raise EngineError("TX_LIMIT", "a transaction is open")
        if not self.store:
            raise EngineError("IO", "no store is open")
        self.draft = Draft(self.store.read().draft())
        return Result(info="transaction begin")

    def _abort(self, q: Query) -> Result:
        self._end(self._open_draft())
        self.draft = None
        self._forget()
        return Result(info="transaction abort")

    def _end(self, draft: Draft) -> None:
        for path in draft.staged:
            self.store.remove(path)

    def _open_draft(self) -> Draft:
        if not self.draft:
            raise EngineError("NO_TX", "no transaction is open")
        return self.draft

    def _commit(self, q: Query) -> Result:
        draft, self.draft = self._open_draft(), None
        state = draft.state
        try:
            for _ in range(_RETRIES):
                head = self.store.head()
                if head > state.version:
                    self._check(draft.state, head)
                    state = self.store.read(head).draft()
                    for step in draft.steps:
                        step(state)
                try:
                    if draft.steps:
                        self.store.publish(state)
                    self._forget()
                    return Result(info="transaction commit")
                except EngineError as e:
                    if e.code != "WRITE_CONFLICT":
                        raise
            raise EngineError("WRITE_CONFLICT", "other writers came first again and again")
        finally:
            self._end(draft)

    def _check(self, mine: State, head: int) -> None:
        """Raise if a commit after ``mine`` began changed a document that it changes."""
        for version in range(mine.version + 1, head + 1):
            for name, path in self.store.read(version).touched:
                for own, own_path in mine.touched:
                    if own != name:
                        continue
                    if path is None or own_path is None:
                        raise EngineError("WRITE_CONFLICT", f"collection '{name}' was changed by another transaction")
                    theirs = self.spark.read.parquet(path)
                    if not self.spark.read.parquet(own_path).join(theirs, "id", "left_semi").isEmpty():
                        raise EngineError("WRITE_CONFLICT", f"a document of '{name}' was changed by another transaction")

    # Writing.

    def _write(self, q: Query) -> Result:
        if q.collection in self.tables or not self.store:
            raise EngineError("IO", f"'{q.collection}' can't be written")
        return self._commit_step(lambda state: self._apply(q, state))

    def _commit_step(self, step: Callable[[State], object]):
        """Do something to the draft, or to the latest state and commit it, anew if another writer came first."""
        if self.draft:
            result = step(self.draft.state)
            self.draft.steps.append(step)
            self._forget()
            return result
        for _ in range(_RETRIES):
            state = self.store.read().draft()
            result = step(state)
            try:
                self.store.publish(state)
                self._forget()
                return result
            except EngineError as e:
                if e.code != "WRITE_CONFLICT":
                    raise
        raise EngineError("WRITE_CONFLICT", "other writers came first again and again")

    def _apply(self, q: Query, state: State) -> Result:
        return {
            "vietinfo": self._insert,
            "cochin": self._update,
            "demlet": self._delete,
            "madeco": self._create,
            "delco": self._drop,
            "madecoidu": self._index,
            "delecoidu": self._unindex,
        }[q.verb](q, state)

    def _made(self, name: str, state: State) -> Collection:
        if name not in state.collections:
            if len(state.collections) >= MAX_COLLECTIONS:
                raise EngineError("MAX_COLLECTIONS", "too many collections")
            state.collections[name] = Collection()
        return state.collections[name]

    def _insert(self, q: Query, state: State) -> Result:
        if not q.documents:
            raise EngineError("NO_PAYLOAD", "no document given")
        c = self._made(q.collection, state)
        made, last = [], 0.0
        for d in q.documents:
            last = d["id"] if isinstance(d.get("id"), float) else float(c.next_id)
            c.next_id = max(c.next_id + ("id" not in d), int(last) + 1)
            made.append({**d, "id": last})
        for part in _alike(made):
            names = {k: _type(v) for d in part for k, v in d.items() if v is not None}
            shape = ", ".join(f"`{n}` {t}" for n, t in names.items())
            c.add(self.store.write(self.spark.createDataFrame([tuple(d.get(n) for n in names) for d in part], shape).coalesce(1), c.indexes))
        self.store.tidy(c)
        return Result(info=f"inserted id={int(last)}" if len(made) == 1 else f"inserted {len(made)} documents", count=len(made))

    def _hits(self, q: Query, c: Collection, state: State) -> tuple[list[Segment], int]:
        """The segments with matching rows and the number of these; notes their ids."""
        where = condition(self.store.frame(c), q.where) if q.where is not None else None
        found, ids = self.store.touched_segments(c, where) if c.segments else ({}, None)
        if found:
            state.touched.append((q.collection, self.store.write_ids(ids)))
        return [s for s in c.segments if any(k in s.path for k in found)], sum(found.values())

    def _update(self, q: Query, state: State) -> Result:
        c = self._collection(q, state)
        if not q.changes:
            raise EngineError("NO_SET_OP", "cochin needs $quy, $don or $loi")
        hit, n = self._hits(q, c, state)
        if not n:
            raise EngineError("NOT_FOUND", "no document matches")
        df = self.store.frame(c, hit)
        new = C.updated(df, condition(df, q.where) if q.where is not None else None, q.changes)
        self._replace(c, hit, new)
        return Result(info=f"updated {n} documents", count=n)

    def _delete(self, q: Query, state: State) -> Result:
        c = self._collection(q, state)
        hit, n = self._hits(q, c, state)
        if n:
            df = self.store.frame(c, hit)
            whole = q.where is None or n == sum(s.rows for s in hit)
            self._replace(c, hit, None if whole else C.deleted(df, condition(df, q.where)))
        return Result(info=f"deleted {n} documents", count=n)

    def _replace(self, c: Collection, old: list[Segment], new: DataFrame | None) -> None:
        """Copy on write: only the segments with changed rows are written anew."""
        c.segments = [s for s in c.segments if s not in old]
        if new is not None:
            c.add(self.store.write(new, c.indexes))

    def _create(self, q: Query, state: State) -> Result:
        if q.collection in state.collections:
            raise EngineError("EXISTS", f"collection '{q.collection}' exists")
        self._made(q.collection, state)
        return Result(info=f"created collection {q.collection}")

    def _drop(self, q: Query, state: State) -> Result:
        self._collection(q, state)
        del state.collections[q.collection]
        state.touched.append((q.collection, None))
        return Result(info=f"dropped collection {q.collection}")

    def _indexed(self, q: Query, state: State) -> tuple[Collection, str]:
        name, point, of = q.collection.partition(".")
        if not point or not of:
            raise EngineError("SYNTAX", "use collection.field")
        return self._collection(Query(q.verb, name), state), of

    def _index(self, q: Query, state: State) -> Result:
        """An index is a note for explain; pruning comes from Parquet's own statistics."""
        c, of = self._indexed(q, state)
        if of in c.indexes:
            raise EngineError("EXISTS", f"index on {q.collection} exists")
        if len(c.indexes) >= MAX_INDEXES:
            raise EngineError("MAX_INDEXES", "too many indexes")
        c.indexes.append(of)
        return Result(info=f"created index on {q.collection}")

    def _unindex(self, q: Query, state: State) -> Result:
        c, of = self._indexed(q, state)
        if of not in c.indexes:
            raise EngineError("NOT_FOUND", f"no index on {q.collection}")
        c.indexes.remove(of)
        return Result(info=f"dropped index on {q.collection}")

    # Imports and care.

    def load(self, name: str, path: str | None = None, text: str | None = None) -> jsonl.ImportStats:
        """Import JSON Lines from a path or a text into a collection."""
        if not self.store:
            raise EngineError("IO", "no store is open")
        begun = time.time()
        df, seen = jsonl.read_file(self.spark, path) if path else jsonl.read_buffer(self.spark, text or "")
        staged = f"{self.store.root}/load-{uuid.uuid4().hex}"
        fields_ = jsonl.stage(df, staged)

        def add(state: State) -> int:
            c = self._made(name, state)
            segment = self.store.write(jsonl.numbered(self.spark, staged, fields_, c.next_id), c.indexes)
            c.add(segment)
            if segment.rows:
                c.next_id = max(c.next_id, int(self.store.frame(c, [segment]).agg(F.max("id")).first()[0]) + 1)
            return segment.rows

        if self.draft:
            self.draft.staged.append(staged)
        try:
            seen.docs_inserted = self._commit_step(add)
        finally:
            if not self.draft:
                self.store.remove(staged)
        seen.elapsed = time.time() - begun
        return seen

    def compact(self, name: str) -> None:
        """Bring a collection's segments together."""

        def step(state: State) -> None:
            state.collections[name] = self.store.compact(self._collection(Query("skill", name), state))
            state.touched.append((name, None))

        self._commit_step(step)

    def set_mode(self, mode: str) -> None:
        """off, heuristic or cost: how much the optimizer may measure.

        These are settings of the Spark session; ``close`` sets them back.
        """
        if mode not in ("off", "heuristic", "cost"):
            raise EngineError("SYNTAX", f"no such mode: {mode}")
        self.mode = mode
        for name, on in (("cbo.enabled", mode == "cost"), ("cbo.joinReorder.enabled", mode == "cost"), ("adaptive.enabled", mode != "off")):
            self._before.setdefault(f"spark.sql.{name}", self.spark.conf.get(f"spark.sql.{name}", None))
            self.spark.conf.set(f"spark.sql.{name}", str(on).lower())


def fields(c: Condition | None) -> list[str]:
    match c:
        case Both(a, b) | Either(a, b):
            return fields(a) + fields(b)
        case Not(of):
            return fields(of)
        case Compare() | Member() | Exists():
            return [c.field]
    return []


def _type(value) -> str:
    return "boolean" if isinstance(value, bool) else "double" if isinstance(value, float) else "string"


def _alike(documents: list[dict]) -> list[list[dict]]:
    """Documents in lists in which no field has two types."""
    parts: list[tuple[dict, list]] = []
    for d in documents:
        types = {k: _type(v) for k, v in d.items() if v is not None}
        for seen, part in parts:
            if all(seen.get(k, t) == t for k, t in types.items()):
                seen |= types
                part.append(d)
                break
        else:
            parts.append((types, [d]))
    return [part for _, part in parts]
