"""One large JSON document read by many tasks.

A document is read as the pieces between its closing braces, which Spark cuts
at byte ranges like lines.  What a byte means depends on all bytes before it,
but only through two things: whether it is inside a string, and how deep it
is nested.  So a first pass over the ranges counts, for both possible starts,
quotes and brackets; sums over the ranges before give every range its start;
and a second pass cuts out the items.  An item over the edge of a range is
put together from its parts, which are the only texts that are shuffled.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.shared import written

# Executors get these helpers inside the task itself.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BRACE = "}"
# Most ranges whose starts are broadcast; beyond, pieces are grouped by range.
MOST_BROADCAST = 50_000


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", BRACE).text(path).select(
        F.input_file_name().alias("file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"), "value"
    )


class Structure:
    """Quotes, brackets, commas and colons of joined pieces."""

    def __init__(self, values: pa.Array):
        values = values.cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        raw = values.buffers()[2]
        text = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
        # Every piece again with the brace that ended it.
        self.data = np.insert(text, ends[1:] - ends[0], ord(BRACE))
        quotes = np.flatnonzero(self.data == ord('"'))
        slashes = self.data == ord("\\")
        if slashes.any():
            # A quote after an odd number of backslashes is part of its string.
            run = np.arange(len(self.data))
            run = run - np.maximum.accumulate(np.where(slashes, -1, run))
            quotes = quotes[(quotes == 0) | (run[quotes - 1] % 2 == 0)]
        self.quotes = quotes
        self.at = np.flatnonzero(_MARK[self.data])
        # Whether an even number of quotes stands before each mark.
        self.even = np.searchsorted(quotes, self.at) % 2 == 0


_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "{}[],:"]] = True
_STEP = np.zeros(256, np.int64)
_STEP[[ord(c) for c in "{["]] = 1
_STEP[[ord(c) for c in "}]"]] = -1


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows of one range after the other."""
    file, block = batch.column("file"), batch.column("block").to_numpy()
    code = file.dictionary_encode().indices.to_numpy()
    cut = np.flatnonzero((np.diff(block) != 0) | (np.diff(code) != 0)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
        if a < b:
            yield (file[a].as_py(), int(block[a])), batch.slice(a, b - a)


_COUNTS = "file string, block long, size long, bytes long, quotes long, net_out long, net_in long, root string"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range: bytes, quotes, and brackets opened less closed for
    a start outside and inside a string."""
    own, state = None, None

    def row():
        return pa.RecordBatch.from_pylist([dict(zip(_NAMES, (*own, *state)))], schema=_SCHEMA)

    for batch in batches:
        for key, rows in _runs(batch):
            if key != own:
                if own is not None:
                    yield row()
                own, state = key, [rows.column("size")[0].as_py(), 0, 0, 0, 0, None]
            s = Structure(rows.column("value"))
            step = _STEP[s.data[s.at]]
            nets = int(step[s.even].sum()), int(step[~s.even].sum())
            if state[2] % 2:
                nets = nets[::-1]
            if state[5] is None and key[1] == 0:
                first = s.data[~np.isin(s.data, [9, 10, 13, 32])]
                state[5] = chr(first[0]) if len(first) else None
            state[1] += len(s.data)
            state[2] += len(s.quotes)
            state[3] += nets[0]
            state[4] += nets[1]
    if own is not None:
        yield row()


_SCHEMA = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("quotes", pa.int64()),
    ("net_out", pa.int64()), ("net_in", pa.int64()), ("root", pa.string()),
])
_NAMES = _SCHEMA.names


def range_starts(pieces: DataFrame) -> DataFrame:
    """``(file, block, inside, depth, level)`` where each range begins.

    ``level`` is the depth at which items are: 1 in an array, 2 in an object.
    A document that ends inside a string or an open bracket raises.
    """
    counts = written(pieces.mapInArrow(_count, _COUNTS), "json-ranges")
    by_file = Window.partitionBy("file").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    inside = counts.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    net = F.when(F.col("inside"), F.col("net_in")).otherwise(F.col("net_out"))
    # The brace after the last piece may be one too many; sizes tell, unless the file is compressed.
    extra = F.sum("bytes").over(whole) - F.col("size")
    end = F.sum("net").over(whole)
    complete = (F.sum("quotes").over(whole) % 2 == 0) & F.when(extra.isin(0, 1), end == -extra).otherwise(end.isin(0, -1))
    ok = F.coalesce(complete & F.col("root").isin("[", "{"), F.lit(False))
    return (
        inside.withColumn("net", net)
        .withColumn("root", F.max("root").over(whole))
        .select(
            "file", "block", "inside",
            F.coalesce(F.sum("net").over(before), F.lit(0)).cast("int").alias("depth"),
            F.when(ok, F.when(F.col("root") == "[", 1).otherwise(2))
            .otherwise(F.raise_error(F.concat(F.lit("invalid JSON in "), F.col("file"))).cast("int")).alias("level"),
        )
    )


# Parts of the cut text: an item, its first, a middle or its last part; a top-level scalar; the end of a range.
WHOLE, FIRST, MIDDLE, LAST, SCALAR, RANGE = range(6)
_CUT = "file string, block long, section int, nth long, part int, opened boolean, key string, kind string, text string"


class _Cutter:
    """Cuts the items of one range."""

    def __init__(self, own: tuple, inside: bool, depth: int, level: int):
        self.own, self.odd, self.depth, self.level = own, int(inside), depth, level
        self.section, self.nth, self.key, self.kind = 0, 0, None, None
        # Text since the last boundary, and which kind of boundary that was.
        self.held: list[bytes] = []
        self.since: str | None = "start" if depth >= level else None
        self.colon: tuple[str | None, list[bytes]] | None = None
        self.rows: list[tuple] = []

    def _emit(self, part: int, text: str | None, key=None, kind=None) -> None:
        self.rows.append((*self.own, self.section, self.nth, part, self.since == "open", key or self.key, kind or self.kind, text))

    def take(self, s: Structure) -> None:
        outside = s.even if not self.odd else ~s.even
        at = s.at[outside]
        char = s.data[at]
        step = _STEP[char]
        after = self.depth + np.cumsum(step)
        level, raw = self.level, s.data.tobytes()
        comma, colon = (char == ord(",")) & (after == level), char == ord(":")
        opens, closes = (step == 1) & (after == level), (step == -1) & (after == level - 1)
        edge = comma | opens | closes
        top = np.zeros(len(at), bool)
        if level == 2:
            # Names of members, and what ends a member without brackets.
            top = (colon & (after == 1)) | ((char == ord(",")) & (after == 1)) | ((step == -1) & (after == 0))
        done = 0
        for i in np.flatnonzero(edge | top).tolist():
            here, c = int(at[i]), chr(char[i])
            if top[i]:
                if c == ":":
                    self.colon = self._name(s, raw, here), [], here + 1
                elif self.colon is not None:
                    name, parts, start = self.colon
                    self._emit(SCALAR, b"".join([*parts, raw[start:here]]).decode("utf-8", "replace"), key=name)
                    self.colon = None
                if not edge[i]:
                    continue
            if opens[i]:
                self.section, self.nth, self.kind = self.section + 1, 0, c
                if level == 2:
                    self.key, self.colon = self.colon[0] if self.colon else None, None
                self.since, self.held, done = "open", [], here + 1
                continue
            if self.since is not None:
                text = b"".join([*self.held, raw[done:here]]).decode("utf-8", "replace")
                if self.since == "start":
                    self._emit(LAST, text)
                elif not (self.since == "open" and closes[i] and not text.strip()):
                    self._emit(WHOLE, text)
                    self.nth += 1
            self.since, self.held, done = ("comma" if comma[i] else None), [], here + 1
        if self.since is not None:
            self.held.append(raw[done:])
        if self.colon is not None:
            name, parts, start = self.colon
            self.colon = name, [*parts, raw[start:]], 0
        self.depth = int(after[-1]) if len(after) else self.depth
        self.odd = (self.odd + len(s.quotes)) % 2

    def _name(self, s: Structure, raw: bytes, colon: int) -> str:
        """The string before a colon; one that began in a range before has a brace in it and is none that is asked for."""
        k = int(np.searchsorted(s.quotes, colon))
        if k < 2:
            return ""
        try:
            return json.loads(raw[s.quotes[k - 2] : s.quotes[k - 1] + 1])
        except ValueError:
            return ""

    def close(self) -> None:
        if self.since is not None:
            text = b"".join(self.held).decode("utf-8", "replace")
            self._emit(MIDDLE if self.since == "start" else FIRST, text)
        # A scalar that goes on in the next range; the last brace of a range ends all others.
        self._emit(RANGE, None if self.colon is None else "open")

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CUT_SCHEMA.types)], schema=_CUT_SCHEMA)


_CUT_SCHEMA = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("section", pa.int32()), ("nth", pa.int64()), ("part", pa.int32()),
    ("opened", pa.bool_()), ("key", pa.string()), ("kind", pa.string()), ("text", pa.string()),
])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = None
    for batch in batches:
        for key, rows in _runs(batch):
            if cutter is None or key != cutter.own:
                if cutter is not None:
                    cutter.close()
                    yield cutter.batch()
                cutter = _Cutter(key, *(rows.column(c)[0].as_py() for c in ("inside", "depth", "level")))
            cutter.take(Structure(rows.column("value")))
        if cutter is not None and cutter.rows:
            yield cutter.batch()
    if cutter is not None:
        cutter.close()
        yield cutter.batch()


def _with_starts(pieces: DataFrame, starts: DataFrame) -> DataFrame:
    """Pieces, in order, beside the start of their range."""
    keys = ["file", "block"]
    if starts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return pieces.drop("size").join(F.broadcast(starts), keys)
    ordered = pieces.drop("size").withColumn("_id", F.monotonically_increasing_id())
    return ordered.join(starts, keys).repartition(*keys).sortWithinPartitions(*keys, "_id").drop("_id")


def split_items(spark: SparkSession, path: str) -> DataFrame:
    """``(source_file, key, kind, item_index, item)`` of large JSON documents.

    The items of an array have a NULL ``key``; in an object, the items of
    every array member have its name.  ``item_index`` counts from 0 within a
    file and key, and ``kind`` is ``[``.  Members without brackets are rows of
    kind ``s`` with their JSON text, without an index.  Members that are
    objects themselves are left out.  An item is JSON text; it is not checked
    here beyond its brackets and quotes.

    Ranges are those of ``spark.sql.files.maxPartitionBytes``; an item and the
    text between two closing braces must fit in memory.
    """
    pieces = _pieces(spark, path)
    cut = written(_with_starts(pieces, written(range_starts(pieces), "json-starts")).mapInArrow(_cut, _CUT), "json-cut", "zstd")
    by_file = Window.partitionBy("file").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.where(F.col("part") == RANGE)
    firsts = cut.where(F.col("part") == FIRST).select("file", "block", F.lit(True).alias("begins"))
    # What a range goes on with: the member, its bracket, and the range in which its first item began.
    begun = F.when(F.col("begins"), F.struct("block", "section"))
    carried = written(
        ends.join(firsts, ["file", "block"], "left").select(
            "file", "block",
            F.last("key", ignorenulls=True).over(before).alias("from_key"),
            F.last("kind", ignorenulls=True).over(before).alias("from_kind"),
            F.last(begun, ignorenulls=True).over(before).alias("from"),
            F.when(F.col("text").isNull(), F.lit(0)).otherwise(
                F.raise_error(F.concat(F.lit("a top-level text reaches over the edge of a range in "), F.col("file"))).cast("int")
            ).alias("fine"),
        ),
        "json-carried",
    )
    named = cut.where(F.col("part") != RANGE).join(carried, ["file", "block"]).where("fine = 0").select(
        "file", "block", "section", "nth", "part", "opened", "text", "from",
        F.when(F.col("section") == 0, F.coalesce("key", "from_key")).otherwise(F.col("key")).alias("key"),
        F.when(F.col("section") == 0, F.coalesce("kind", "from_kind")).otherwise(F.col("kind")).alias("kind"),
    )
    listed = named.where("kind = '['")
    part = F.col("part")
    over = listed.where(part.isin(FIRST, MIDDLE, LAST)).select(
        "file",
        F.when(part == FIRST, F.col("block")).otherwise(F.col("from.block")).alias("begun"),
        F.struct("block", "text").alias("piece"),
        F.when(part == FIRST, F.struct("section", "nth", "key", "opened")).alias("first"),
    )
    joined = over.groupBy("file", "begun").agg(
        F.max("first").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["text"]), "").alias("text"),
    ).where(F.col("first").isNotNull() & ~(F.col("first.opened") & (F.trim(F.translate("text", "\n\r\t", "   ")) == "")))
    items = listed.where(part == WHOLE).select("file", "block", "section", "nth", "key", "text").unionByName(
        joined.select("file", F.col("begun").alias("block"), "first.section", "first.nth", "first.key", "text")
    )
    earlier = Window.partitionBy("file", "key").orderBy("block", "section").rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that its size is known before the join and the items need not be moved for it.
    sections = written(
        items.groupBy("file", "block", "section", "key").agg(F.count(F.lit(1)).alias("n")).select(
            "file", "block", "section", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
        ),
        "json-sections",
    )
    numbered = items.join(sections, ["file", "block", "section"]).select(
        F.col("file").alias("source_file"), "key", F.lit("[").alias("kind"), (F.col("start") + F.col("nth")).alias("item_index"),
        F.col("text").alias("item"),
    )
    scalars = named.where(part == SCALAR).select(
        F.col("file").alias("source_file"), "key", F.lit("s").alias("kind"), F.lit(None).cast("long").alias("item_index"),
        F.col("text").alias("item"),
    )
    return numbered.unionByName(scalars)


def _search(text: str, key: str) -> str | None:
    """JSON text of the first member called ``key``, depth first, that is not null.

    Depth first, objects come in the order in which they begin.  So of all
    places of the key, the one whose object begins first is taken; if it holds
    null, what lies inside that object is passed over.
    """
    if key not in text and "\\" not in text:
        return None
    s = Structure(pa.array([text], pa.large_string()))
    raw, at = s.data[:-1].tobytes(), s.at[s.even]
    at = at[at < len(raw)]
    open_, places, ends = [], [], {}
    for here in at.tolist():
        c = raw[here]
        if c in b"{[":
            open_.append(here)
        elif c in b"}]":
            if open_:
                ends[open_.pop()] = here
        elif c == ord(":") and open_:
            k = int(np.searchsorted(s.quotes, here))
            if k >= 2 and _same_name(raw[s.quotes[k - 2] : s.quotes[k - 1] + 1], key):
                places.append((open_[-1], here + 1))
    passed, last = -1, dict(places)  # a name given twice in an object: the last one counts
    for begin in sorted(last):
        if begin < passed:
            continue
        start = last[begin]
        value = raw[start : _value_end(raw, at, start, ends)].decode("utf-8", "replace").strip()
        if value != "null":
            return value
        passed = ends.get(begin, len(raw))
    return None


def _same_name(raw: bytes, key: str) -> bool:
    try:
        return json.loads(raw) == key
    except ValueError:
        return False


def _value_end(raw: bytes, marks: np.ndarray, start: int, ends: dict[int, int]) -> int:
    """Where the value that begins at or after ``start`` ends."""
    here = int(marks[i]) if (i := int(np.searchsorted(marks, start))) < len(marks) else len(raw)
    return ends.get(here, len(raw) - 1) + 1 if here < len(raw) and raw[here] in b"{[" else here


def first_member(column, key: str) -> Column:
    """The first member called ``key`` that is not null, at any depth of a
    JSON text, as JSON text (a string without quotes); NULL if there is none.

    Only this column goes through Python, and NULL costs nothing there: give
    it the texts in which the member is not where it is expected.
    """

    @F.arrow_udf("string")
    def search(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _search(t, key) for t in texts.to_pylist()], pa.string())

    # Written as Spark writes parts of a text it has parsed.
    return F.get_json_object(F.concat(F.lit('{"x":'), search(column), F.lit("}")), "$.x")
