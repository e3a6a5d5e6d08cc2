"""The five shop tables and where they come from.

``open_shop(spark, path)`` reads the tables from ``path`` when they are
stored there (``website_sessions.parquet`` ...), and otherwise derives
them from ``path/events.parquet``. ``stage_shop`` writes the derived
tables once into the shared checkpoint folder; ``open_shop`` does that on
its first call in an application, so a batch of reports reads written
tables instead of re-deriving them per report. ``derive_shop`` is the
lazy plan itself.
"""

from __future__ import annotations

import hashlib
import inspect
import threading
import uuid
import warnings
from urllib.parse import unquote
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from cartwheel.session import NoSharedFolder, checkpoint_dir, prefer_settings
from cartwheel.sources import events as E
from cartwheel.sources import facts as FA
from cartwheel.sources import increment as I
from cartwheel.sources.facts import session_facts
from cartwheel.sources.files import FileTable, NotByFile, digest, hadoop, listing, plain

FACTS_FILE = "session_facts"

# table name on disk -> ShopTables field
TABLE_FILES = {
    "website_sessions": "sessions",
    "website_pageviews": "pageviews",
    "orders": "orders",
    "order_items": "order_items",
    "order_item_refunds": "refunds",
}

# amounts are widened to this type; a stored decimal that needs more digits keeps its own
MONEY = "decimal(18,2)"

# column -> Spark type of every table (FIXTURES.md section 1)
SCHEMAS = {
    "sessions": {
        "website_session_id": "bigint",
        "created_at": "timestamp_ntz",
        "user_id": "bigint",
        "is_repeat_session": "int",
        "utm_source": "string",
        "utm_campaign": "string",
        "device_type": "string",
        "http_referer": "string",
    },
    "pageviews": {
        "website_pageview_id": "bigint",
        "created_at": "timestamp_ntz",
        "website_session_id": "bigint",
        "pageview_url": "string",
    },
    "orders": {
        "order_id": "bigint",
        "created_at": "timestamp_ntz",
        "website_session_id": "bigint",
        "primary_product_id": "int",
        "items_purchased": "int",
        "price_usd": MONEY,
        "cogs_usd": MONEY,
    },
    "order_items": {
        "order_item_id": "bigint",
        "created_at": "timestamp_ntz",
        "order_id": "bigint",
        "product_id": "int",
        "is_primary_item": "int",
        "price_usd": MONEY,
        "cogs_usd": MONEY,
    },
    "refunds": {"order_item_id": "bigint"},
}


# the column that identifies a row; a refund may be recorded more than once
KEYS = {"sessions": "website_session_id", "pageviews": "website_pageview_id", "orders": "order_id", "order_items": "order_item_id"}


class RepeatedIds(ValueError):
    """A table holds two different rows with one id, so it is unclear what the id stands for."""


@dataclass(frozen=True)
class ShopTables:
    sessions: DataFrame
    pageviews: DataFrame
    orders: DataFrame
    order_items: DataFrame
    refunds: DataFrame
    # gives the written per-session answers (``sources.facts``), or None; called by the first report that reads them
    facts: Callable[[], DataFrame | None] | None = None
    # called with a table's name when a report takes that table; gives the table whose repeated rows are merged, if it has any
    before_use: Callable[[str], DataFrame | None] | None = None

    def __getattribute__(self, name: str):
        if name in KEYS:
            check = object.__getattribute__(self, "before_use")
            merged = check(name) if check is not None else None
            if merged is not None:
                return merged
        return object.__getattribute__(self, name)

    @property
    def session_facts(self) -> DataFrame | None:
        return self.facts() if self.facts is not None else None

    def conform(self) -> ShopTables:
        """Project every table to its documented columns and types."""
        out = {}
        for name, cols in SCHEMAS.items():
            df: DataFrame = getattr(self, name)
            missing = [c for c in cols if c not in df.columns]
            if missing:
                raise ValueError(f"{name}: missing columns {missing}")
            out[name] = df.select(*[F.col(c).cast(_type_of(df, c, t)).alias(c) for c, t in cols.items()])
        return replace(self, **out)


def _type_of(df: DataFrame, column: str, wanted: str):
    stored = df.schema[column].dataType
    if wanted == MONEY and isinstance(stored, DecimalType) and (stored.scale > 2 or stored.precision - stored.scale > 16):
        return stored
    return wanted


def derive_shop(events: DataFrame) -> ShopTables:
    """Lazy plans of the five tables, derived from the click stream."""
    views, blocks = E.tag_events(events)
    return _from_tagged(views, blocks)


def _from_tagged(views: DataFrame, blocks: DataFrame) -> ShopTables:
    items = E.derive_order_items(views)
    return ShopTables(
        sessions=E.derive_sessions(blocks),
        pageviews=E.derive_pageviews(views),
        orders=E.derive_orders(views),
        order_items=items,
        refunds=E.derive_refunds(items),
    ).conform()


# what this process knows of its inputs, by application: staged folders by tag, and file tables by their place
_STAGED: dict[tuple[str, str], str] = {}
_FILE_TABLES: dict[tuple[str, str], FileTable] = {}
_STAGE_LOCK = threading.RLock()


def _code_hash(*modules) -> str:
    h = hashlib.sha1(repr(sorted(SCHEMAS.items())).encode())
    for m in modules:
        h.update(inspect.getsource(m).encode())  # also from a zip shipped to executors
    return h.hexdigest()[:12]


# staged copies are reused only by the same derivation code
DERIVATION_VERSION = _code_hash(E, FA, I)
COMPLETE_MARK = "_COMPLETE"


def _join(root: str, name: str) -> str:
    return root.rstrip("/") + "/" + name


_fs = hadoop


def _exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return bool(fs.exists(jpath))


def _tag(spark: SparkSession, paths: Iterable[str]) -> tuple[str, int]:
    """Digest over every file below ``paths`` (name, length, modification
    time) and the derivation code, and the files' bytes. Any rewritten,
    added or removed file gives another tag."""
    found = {name: state for path in paths for name, state in listing(spark, path).items()}
    files = [f"{name}|{length}|{changed}" for name, (length, changed) in found.items()]
    return digest([DERIVATION_VERSION, *sorted(files)]), sum(length for length, _ in found.values())


# target size of one staged page-view file (compressed parquet)
STAGED_FILE_BYTES = 256 * 1024 * 1024


def _tables_at(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {field: spark.read.parquet(_join(root, f"{name}.parquet")) for name, field in TABLE_FILES.items()}


# a staged folder's own record: the copy it adds to (if any), and the event files it holds the derivation of
MANIFEST, BASE_FILE = "_manifest.parquet", "_base.parquet"
# increments in a row after which, and share of new bytes beyond which, everything is staged anew
MOST_INCREMENTS, MOST_NEW = 8, 0.25


def _base_of(spark: SparkSession, root: str) -> str | None:
    path = _join(root, BASE_FILE)
    return spark.read.parquet(path).first()[0] if _exists(spark, path) else None


def _staged_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a staged folder: its own rows, and those of the copy it adds to that it does not replace."""
    base = _base_of(spark, root)
    if base is None:
        return _tables_at(spark, root)
    gone = {name: spark.read.parquet(_join(root, f"_gone_{name}.parquet")) for name in I.GONE}
    return I.combined(_staged_tables(spark, base), _tables_at(spark, root), gone)


def _staged_shop(spark: SparkSession, root: str) -> ShopTables:
    """The tables of a staged folder; its ids are unique by derivation."""
    return ShopTables(**_staged_tables(spark, root), facts=lambda: _staged_facts(spark, root)).conform()


def _staged_facts(spark: SparkSession, root: str) -> DataFrame:
    """Session facts of a staged folder: those of its own page views, and of the base's sessions that it does not replace."""
    own = _facts_at(spark, root, spark.read.parquet(_join(root, "website_pageviews.parquet")))
    base = _base_of(spark, root)
    if base is None:
        return own
    gone = spark.read.parquet(_join(root, "_gone_views.parquet"))
    return _staged_facts(spark, base).join(gone, "website_session_id", "left_anti").unionByName(own)


def _facts_at(spark: SparkSession, root: str, views: DataFrame) -> DataFrame:
    """The session facts written beside staged tables, or below ``root``, by the first report that reads them."""
    path, mark = _join(root, f"{FACTS_FILE}.parquet"), _join(root, f"_{FACTS_FILE}{COMPLETE_MARK}")
    with _STAGE_LOCK:
        if not _exists(spark, mark):
            session_facts(views).sortWithinPartitions("website_session_id").write.mode("overwrite").parquet(path)
            _touch(spark, mark)
    return spark.read.parquet(path)


def _touch(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    fs.create(jpath, True).close()


def _given_shop(
    spark: SparkSession, tables: dict[str, DataFrame], files: Callable[[str], dict[str, tuple[int, int]]],
    read: Callable[[str, list[str]], DataFrame], stage: bool,
) -> ShopTables:
    """Tables that somebody else wrote: checked and given facts when a report first uses them.

    ``files`` lists a table's files, ``read`` gives the rows of some of
    them. A table without files (a view over something else) is checked
    at each use and has no facts. Rows that were loaded more than once, equal in all documented
    columns, count once: the files that hold them are merged, the others
    are read as they are. Two different rows with one id are refused.
    """
    shop = ShopTables(**tables).conform()
    base = _shared_folder(spark)
    listed: dict[str, dict] = {}  # one listing per table for this batch of reports
    merged: dict[str, DataFrame | None] = {}

    def known(name: str) -> dict[str, tuple[int, int]]:
        if name not in listed:
            listed[name] = files(name)
        return listed[name]

    def conformed(name: str, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).cast(_type_of(df, c, t)).alias(c) for c, t in SCHEMAS[name].items()])

    def check(name: str) -> DataFrame | None:
        with _STAGE_LOCK:
            if name not in merged:
                merged[name] = merge(name)
        return merged[name]

    def merge(name: str) -> DataFrame | None:
        now, column = known(name), KEYS[name]
        whole = object.__getattribute__(shop, name)
        if not now:
            return unfiled(name, whole)
        place = digest([name, *sorted({plain(f).rsplit("/", 1)[0] for f in now})])
        key = (spark.sparkContext.applicationId, place)
        table = _FILE_TABLES.get(key)
        if table is None:
            table = _FILE_TABLES[key] = FileTable(spark, column, base and _join(base, f"files-{name}-{place}"))
        try:
            dirty = table.update(now, lambda some: read(name, some))
        except NotByFile:
            return unfiled(name, whole)
        if not dirty:
            return None
        again = set(dirty)
        clean = [f for f in now if f not in again]
        repaired = once_each(conformed(name, read(name, dirty)), column)
        if base:
            tag = digest([DERIVATION_VERSION, name, *sorted(f"{f}|{now[f]}" for f in dirty)])
            path, mark = _join(base, f"merged-{name}-{tag}"), _join(base, f"merged-{name}-{tag}{COMPLETE_MARK}")
            if not _exists(spark, mark):
                repaired.write.mode("overwrite").parquet(path)
                _touch(spark, mark)
            repaired = spark.read.parquet(path)
        refuse_different(name, repaired)
        return repaired.unionByName(conformed(name, read(name, clean))) if clean else repaired

    def facts() -> DataFrame | None:
        now = known("pageviews")
        if not (stage and base and now):
            return None
        tag = digest([DERIVATION_VERSION, *sorted(f"{f}|{state}" for f, state in now.items())])
        return _facts_at(spark, _join(base, f"facts-{tag}"), check("pageviews") or object.__getattribute__(shop, "pageviews"))

    return replace(shop, facts=facts, before_use=check)


def _a_repeat(df: DataFrame, column: str):
    """An id that occurs more than once, or None."""
    found = df.filter(F.col(column).isNotNull()).groupBy(column).count().filter("count > 1").select(column).limit(1).collect()
    return found[0][0] if found else None


def refuse_different(name: str, df: DataFrame) -> None:
    twice = _a_repeat(df, KEYS[name])
    if twice is not None:
        raise RepeatedIds(f"{name}: {KEYS[name]} {twice} stands for different rows; remove all but one")


def unfiled(name: str, df: DataFrame) -> DataFrame | None:
    """A table without files of its own: its repeated rows merged in the plan, None where there are none."""
    if _a_repeat(df, KEYS[name]) is None:
        return None
    merged = once_each(df, KEYS[name])
    refuse_different(name, merged)
    return merged


def once_each(df: DataFrame, column: str) -> DataFrame:
    """``df`` with rows that are equal in all columns once; rows without an id stay as they are."""
    return df.filter(F.col(column).isNotNull()).dropDuplicates().unionByName(df.filter(F.col(column).isNull()))


def _reusable(spark: SparkSession, base: str, tag: str, kind: str = "shop") -> str | None:
    """A completed staged copy of the same input, left by any application."""
    fs, jpath = _fs(spark, base)
    if not fs.exists(jpath):
        return None
    for status in fs.listStatus(jpath):
        name = status.getPath().getName()
        root = _join(base, name)
        if name.startswith(f"{kind}-{tag}-") and _exists(spark, _join(root, COMPLETE_MARK)):
            return root
    return None


# session setting: "auto" stages derived tables on first use, "off" keeps
# every report a lazy plan over the events
STAGE_CONF = "spark.cartwheel.stage"


def catalog_shop(spark: SparkSession, database: str | None = None, stage: bool | None = None) -> ShopTables:
    """The shop tables from the Spark catalog: ``database.website_sessions``
    and so on, or -- without a database -- the current database and temp
    views of those names (the ``use <schema>`` of a SQL session). Tables
    over files are checked and get session facts as in ``open_shop``.
    """
    prefer_settings(spark)
    prefix = f"{database}." if database else ""
    tables = {field: spark.table(prefix + name) for name, field in TABLE_FILES.items()}

    def files(name: str) -> dict[str, tuple[int, int]]:
        if not _is_plain_scan(tables[name]):  # what files hold is not what a view over them holds
            return {}
        folders = {f.rsplit("/", 1)[0] for f in tables[name].inputFiles()}
        mine = {plain(f) for f in tables[name].inputFiles()}
        return {f: state for folder in folders for f, state in listing(spark, unquote(folder)).items() if plain(f) in mine}

    def read(name: str, some: list[str]) -> DataFrame:
        wanted = [plain(f) for f in some]
        return tables[name].filter(F.regexp_replace(F.url_decode(F.input_file_name()), "^file:/+", "/").isin(wanted))

    return _given_shop(spark, tables, files, read, _wanted(spark, stage))


def _is_plain_scan(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().optimizedPlan()  # noqa: SLF001
    return plan.getClass().getSimpleName() == "LogicalRelation"


def _wanted(spark: SparkSession, stage: bool | None) -> bool:
    return spark.conf.get(STAGE_CONF, "auto") != "off" if stage is None else stage


def _shared_folder(spark: SparkSession) -> str | None:
    """The shared checkpoint folder, or None (with a warning) on a cluster that names none."""
    try:
        return checkpoint_dir(spark)
    except NoSharedFolder as err:
        warnings.warn(f"cartwheel: nothing is staged: {err}", stacklevel=3)
        return None


def open_shop(spark: SparkSession, path: str, stage: bool | None = None, sessions_only: bool = False) -> ShopTables:
    """The shop tables of ``path``: stored, staged, or derived from events.

    Stored tables are read as they are, but for files that hold rows more
    than once: the first report that uses a table looks into its new files
    (``files.FileTable``), merges repeated rows, and refuses different rows
    with one id (``RepeatedIds``). The first report that needs session facts
    writes them.

    When the tables have to be derived, the first call stages them
    (``stage_shop``) and later calls read the written copy, as long as
    every input file is what it was: the files are listed on each call.
    ``stage=False`` or the session setting ``spark.cartwheel.stage=off``
    keep the lazy plan, and so does a cluster without a shared checkpoint
    folder. Any error while staging is raised.

    ``sessions_only`` says that no other table will be read: then only the
    sessions are staged, unless all tables are already. Another table that is
    read all the same is staged at that time.
    """
    path = path.rstrip("/")
    prefer_settings(spark)
    stage = _wanted(spark, stage)
    if all(_exists(spark, _join(path, f"{name}.parquet")) for name in TABLE_FILES):
        names = {field: _join(path, f"{name}.parquet") for name, field in TABLE_FILES.items()}
        tables = _tables_at(spark, path)

        def read(name: str, some: list[str]) -> DataFrame:
            return spark.read.schema(tables[name].schema).option("basePath", names[name]).parquet(*some)

        return _given_shop(spark, tables, lambda name: listing(spark, names[name]), read, stage)
    if stage and _shared_folder(spark) is not None:
        # reports started from several threads stage a source only once
        with _STAGE_LOCK:
            return _sessions_shop(spark, path) if sessions_only else _staged_shop(spark, stage_shop(spark, path))
    return derive_shop(spark.read.parquet(_join(path, "events.parquet")))


def stage_shop(spark: SparkSession, path: str, files_per_table: int | None = None, reuse: bool = True) -> str:
    """Derive the tables of ``path`` once and write them as parquet.

    Sessions and page views are range-partitioned on the session id (ids
    rise with time, so each file covers a time span and its row-group
    statistics let date filters skip data), page views sorted by session
    then view id inside each file. The folder lives under the session's
    checkpoint directory, with about 256 MB per page-view file unless
    ``files_per_table`` says otherwise, and is marked complete when every
    table is written; with ``reuse`` a complete copy of the same input (the
    same files with the same lengths and modification times), left by any
    application, is used instead of staging again. Where a complete copy
    holds some of the files as they are now and the others are new and not
    too many, only what they touch is derived and written, beside that copy
    (``increment``). An incomplete folder is removed when staging fails, and
    so is a copy of input that changed meanwhile.
    """
    path = path.rstrip("/")
    events_path = _join(path, "events.parquet")
    base = checkpoint_dir(spark)
    tag, input_bytes = _tag(spark, [events_path])
    known = (spark.sparkContext.applicationId, tag)
    if reuse:
        found = _STAGED.get(known) or _reusable(spark, base, tag)
        if found is not None:
            _STAGED[known] = found
            return found
    source = digest([DERIVATION_VERSION, events_path])
    files = listing(spark, events_path)
    root = _join(base, f"shop-{tag}-{source}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}")
    n = files_per_table or _files_per_table(spark, input_bytes)
    with _new_folder(spark, root, events_path, tag):
        before = _earlier(spark, base, source, files) if reuse else None
        if before is not None:
            _write_increment(spark, events_path, root, files, *before)
        else:
            _write_tables(spark, events_path, root, n)
        rows = [(plain(f), length, changed) for f, (length, changed) in files.items()]
        spark.createDataFrame(rows, "path string, length long, changed long").coalesce(1).write.parquet(_join(root, MANIFEST))
    _STAGED[known] = root
    return root


def _files_per_table(spark: SparkSession, input_bytes: int) -> int:
    # enough that a page-view file stays near STAGED_FILE_BYTES (the views are about as large as the events)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // STAGED_FILE_BYTES))


@contextmanager
def _new_folder(spark: SparkSession, root: str, events_path: str, tag: str) -> Iterator[None]:
    """Marks ``root`` complete when it is written; removes it on an error, or when its input changed meanwhile."""
    fs, folder = _fs(spark, root)
    try:
        yield
        if _tag(spark, [events_path])[0] != tag:
            raise RuntimeError(f"{events_path} changed while it was staged")
    except BaseException:
        fs.delete(folder, True)
        raise
    _touch(spark, _join(root, COMPLETE_MARK))


def _sessions_shop(spark: SparkSession, path: str) -> ShopTables:
    """The tables of ``path`` with only the sessions staged, until another table is read."""
    root, whole = stage_sessions(spark, path)
    if whole:
        return _staged_shop(spark, root)
    stored = spark.read.parquet(_join(root, "website_sessions.parquet"))
    shop = replace(derive_shop(spark.read.parquet(_join(path, "events.parquet"))), sessions=stored).conform()
    staged: list[ShopTables] = []

    def all_tables() -> ShopTables:
        if not staged:
            staged.append(open_shop(spark, path, True))
        return staged[0]

    def table(name: str) -> DataFrame | None:
        return None if name == "sessions" else getattr(all_tables(), name)

    return replace(shop, facts=lambda: all_tables().session_facts, before_use=table)


def stage_sessions(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(folder that holds the staged sessions of ``path``, whether it holds the other tables too).

    A complete copy of all tables is used where there is one, or one that
    only new files have to be added to. Otherwise the sessions are derived
    alone, from each block's least id and first second.
    """
    path = path.rstrip("/")
    events_path = _join(path, "events.parquet")
    base = checkpoint_dir(spark)
    tag, input_bytes = _tag(spark, [events_path])
    application = spark.sparkContext.applicationId
    if _STAGED.get((application, tag)) or _reusable(spark, base, tag):
        return stage_shop(spark, path), True
    known = (application, f"sessions-{tag}")
    found = _STAGED.get(known) or _reusable(spark, base, tag, "sessions")
    if found is None:
        source = digest([DERIVATION_VERSION, events_path])
        if _earlier(spark, base, source, listing(spark, events_path)) is not None:
            return stage_shop(spark, path), True
        found = _join(base, f"sessions-{tag}-{source}-{application}-{uuid.uuid4().hex[:8]}")
        with _new_folder(spark, found, events_path, tag):
            _write_sessions(spark, events_path, found, _files_per_table(spark, input_bytes))
    _STAGED[known] = found
    return found, False


def _earlier(spark: SparkSession, base: str, source: str, files: dict[str, tuple[int, int]]) -> tuple[str, set[str]] | None:
    """The staged copy that holds most of ``files`` and nothing else, and the files it holds."""
    now = {plain(f): state for f, state in files.items()}
    fs, jpath = _fs(spark, base)
    best: tuple[int, str, set[str]] | None = None
    for status in fs.listStatus(jpath) if fs.exists(jpath) else ():
        name = status.getPath().getName()
        root = _join(base, name)
        if not (name.startswith("shop-") and f"-{source}-" in name and _exists(spark, _join(root, COMPLETE_MARK))):
            continue
        held = {r.path: (r.length, r.changed) for r in spark.read.parquet(_join(root, MANIFEST)).collect()}
        if held and all(now.get(p) == tuple(state) for p, state in held.items()):
            size = sum(length for length, _ in held.values())
            if best is None or size > best[0]:
                best = (size, root, set(held))
    if best is None:
        return None
    chain, at = 0, best[1]
    while at is not None:
        chain, at = chain + 1, _base_of(spark, at)
    new = sum(length for p, (length, _) in now.items() if p not in best[2])
    return best[1:] if chain <= MOST_INCREMENTS and new <= MOST_NEW * best[0] else None


def _write_increment(spark: SparkSession, events_path: str, root: str, files: dict[str, tuple[int, int]], base: str, held: set[str]) -> None:
    def rows(names: list[str]) -> DataFrame:
        return spark.read.schema(schema).option("basePath", events_path).parquet(*names)

    schema = spark.read.parquet(events_path).schema
    old, new = rows([f for f in files if plain(f) in held]), rows([f for f in files if plain(f) not in held])

    def written(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(_join(root, f"{name}.parquet"))
        return spark.read.parquet(_join(root, f"{name}.parquet"))

    scratch = ("_touched", "_tagged", "_blocks")
    delta, gone = I.increment(old, new, _staged_tables(spark, base), written)
    # the same columns and types as the base's tables have
    for name, df in delta.items():
        kinds = SCHEMAS[TABLE_FILES[name]]
        df.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()]).write.parquet(_join(root, f"{name}.parquet"))
    for name, df in gone.items():
        df.write.parquet(_join(root, f"_gone_{name}.parquet"))
    spark.createDataFrame([(base,)], "base string").coalesce(1).write.parquet(_join(root, BASE_FILE))
    for name in scratch:
        fs, folder = _fs(spark, _join(root, f"{name}.parquet"))
        fs.delete(folder, True)


def _sessions_layout(sessions: DataFrame, n: int) -> DataFrame:
    return sessions.repartitionByRange(n, "website_session_id").sortWithinPartitions("website_session_id")


def _write_sessions(spark: SparkSession, events_path: str, root: str, n: int) -> None:
    blocks_path = _join(root, "_blocks.parquet")
    E.session_rows(spark.read.parquet(events_path)).write.mode("overwrite").parquet(blocks_path)
    sessions = E.derive_sessions(spark.read.parquet(blocks_path))
    sessions = sessions.select(*[F.col(c).cast(t).alias(c) for c, t in SCHEMAS["sessions"].items()])
    _sessions_layout(sessions, n).write.mode("overwrite").parquet(_join(root, "website_sessions.parquet"))
    fs, blocks_folder = _fs(spark, blocks_path)
    fs.delete(blocks_folder, True)


def _write_tables(spark: SparkSession, events_path: str, root: str, n: int) -> None:
    # tag the events once and cut the lineage there: the five tables are
    # then projections of one written table (a block's first view carries
    # everything its session row needs), which goes when they are written
    views, _ = E.tag_events(spark.read.parquet(events_path))
    tagged_path = _join(root, "_tagged_events.parquet")
    views.write.mode("overwrite").parquet(tagged_path)
    tagged = spark.read.parquet(tagged_path)
    shop = _from_tagged(tagged, tagged.filter(F.col("n") == 1).select("user_id", "blk", "sid", "secs0", "st"))
    layout = {
        "website_sessions": _sessions_layout(shop.sessions, n),
        "website_pageviews": shop.pageviews.repartitionByRange(n, "website_session_id").sortWithinPartitions(
            "website_session_id", "website_pageview_id"
        ),
        "orders": shop.orders.repartitionByRange(n, "order_id").sortWithinPartitions("order_id"),
        "order_items": shop.order_items.repartitionByRange(n, "order_item_id").sortWithinPartitions("order_item_id"),
        "order_item_refunds": shop.refunds.repartitionByRange(max(1, n // 4), "order_item_id"),
    }
    # side by side: a write's last tasks, its range sample and its commit leave cores idle
    write = inheritable_thread_target(spark)(lambda name: layout[name].write.mode("overwrite").parquet(_join(root, f"{name}.parquet")))
    with ThreadPoolExecutor(len(layout)) as pool:
        list(pool.map(write, layout))
    fs, tagged_folder = _fs(spark, tagged_path)
    fs.delete(tagged_folder, True)
