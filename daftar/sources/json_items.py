"""Items of an array inside JSON files of any size, read by byte ranges: one file is as many tasks as it has ranges, and no task holds more than a batch and one item.

Spark's text reader cuts a file at every `}`, so that ranges begin and end there, also when the brace stands in a string; a row is shorter than an item. Whether
a range begins inside a string, and inside which objects and arrays, follows from all ranges before it. So there are three steps:

1. Every range is scanned for both cases, beginning outside and inside a string, into a summary: whether the case flips by its end, how many containers opened
   before it closes, and the names of those that it leaves open. Summaries compose: two that follow each other are one.
2. The summaries of each file, one small row a range, are carried over in order. That gives each range its beginning.
3. Every range is scanned once more and cut into items. Those that lie in several ranges are put together from their pieces.

A path names keys from the root, `item` for elements of arrays, as `law_sources.articles.item`; `item` alone are the elements of a root array. Items are objects.
Files that end early give the items that are complete, as do files with text behind the root's end. Of a compressed file, which is one range, the end is taken to be whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGES = "path string, start long"


class Events(NamedTuple):
    """Brackets outside strings: places, +1 or -1, the depth after each, relative to the beginning; places of all quotes; whether the end is in a string."""

    at: np.ndarray
    step: np.ndarray
    depth: np.ndarray
    quotes: np.ndarray
    in_string: bool


def events(data: np.ndarray, in_string: bool) -> Events:
    quotes = np.flatnonzero(data == ord('"'))
    slashes = data == ord("\\")
    if len(quotes) and slashes.any():
        # A quote behind an odd number of backslashes is escaped: count back to the last byte that is none.
        last = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(data))))
        before = np.where(quotes > 0, quotes - 1 - last[np.maximum(quotes - 1, 0)], 0)
        quotes = quotes[before % 2 == 0]
    opening = (data == ord("{")) | (data == ord("["))
    at = np.flatnonzero(opening | (data == ord("}")) | (data == ord("]")))
    inside = (np.searchsorted(quotes, at) + in_string) % 2 == 1
    at = at[~inside]
    step = np.where(opening[at], 1, -1)
    return Events(at, step, np.cumsum(step), quotes, bool((len(quotes) + in_string) % 2))


_SPACE = b" \t\r\n"


def name(data: bytes, quotes: np.ndarray, at: int) -> str | None:
    """The key of the container that opens at a place, `item` in an array; None if its key begins before the data."""
    i = at - 1
    while i >= 0 and data[i] in _SPACE:
        i -= 1
    if i < 0 or data[i] != ord(":"):
        return "item"
    n = int(np.searchsorted(quotes, i))
    return None if n < 2 else data[int(quotes[n - 2]) + 1 : int(quotes[n - 1])].decode(errors="replace")


def entry(data: bytes, quotes: np.ndarray, at: int) -> str:
    """A container on the stack: its bracket and its name."""
    return chr(data[at]) + (name(data, quotes, at) or "")


def fits(stack: list[str], parent: list[str]) -> bool:
    """Whether elements of the innermost container that `parent` names are open, or would open, here."""
    level = len(parent) + 1
    return len(stack) >= level and [x[1:] for x in stack[1:level]] == parent and stack[level - 1][0] == "["


def left_open(data: bytes, e: Events) -> tuple[int, list[str | None]]:
    """How many containers from before the data it closes, and the names of those it leaves open."""
    if not len(e.at):
        return 0, []
    closed = max(0, -int(e.depth.min()))
    still = np.flatnonzero((e.step > 0) & (e.depth <= np.minimum.accumulate(e.depth[::-1])[::-1]))
    return closed, [entry(data, e.quotes, int(e.at[i])) for i in still.tolist()]


def followed(stack: list, closed: int, opened: list) -> tuple[int, list]:
    """The stack after a summary; closes that find nothing open are counted."""
    kept = len(stack) - closed
    return max(0, -kept), stack[: max(0, kept)] + opened


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, int, bytes]]:
    """(file, start of the range, text with the braces it was cut at) of each range in a batch."""
    paths, starts, texts = (batch.column(c).to_pylist() for c in ("path", "start", "value"))
    lo = 0
    while lo < len(texts):
        hi = lo
        while hi < len(texts) and paths[hi] == paths[lo] and starts[hi] == starts[lo]:
            hi += 1
        yield paths[lo], starts[lo], b"}".join([*texts[lo:hi], b""])
        lo = hi


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], list] = {}
    for batch in batches:
        sizes = dict(zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True))
        for path, start, data in _rows(batch):
            row = held.setdefault((path, start), [sizes[path], 0, [False, 0, []], [True, 0, []]])
            row[1] += len(data)
            bytes_ = np.frombuffer(data, np.uint8)
            for case in row[2:]:
                e = events(bytes_, case[0])
                more, case[2] = followed(case[2], *left_open(data, e))
                case[0], case[1] = e.in_string, case[1] + more
    for (path, start), (size, n, *cases) in held.items():
        columns = [[path], [start], [size], [n], *([c[i]] for c in cases for i in range(3))]
        kinds = [pa.string(), *[pa.int64()] * 3, *[pa.bool_(), pa.int64(), pa.list_(pa.string())] * 2]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "start", "size", "n", "out0", "closed0", "opened0", "out1", "closed1", "opened1"])


def _carried(parent: list[str]):
    """Carries one file's summaries over: what each range begins with; if an item is open there, in which range it began; whether the range ends the file without a brace."""

    def carry(file: pa.Table) -> pa.Table:
        level, stack, in_string, began, rows = len(parent) + 1, [], False, None, []
        ranges = sorted(file.to_pylist(), key=lambda r: r["start"])
        for r in ranges:
            rows.append({"path": r["path"], "start": r["start"], "in_string": in_string, "stack": list(stack), "began": began, "cut_off": False})
            case = "1" if in_string else "0"
            closed, opened = r["closed" + case], r["opened" + case]
            goes_on = began is not None and len(stack) - closed > level
            _, stack = followed(stack, closed, opened)
            in_string = r["out" + case]
            began = (began if goes_on else r["start"]) if len(stack) > level and fits(stack, parent) else None
        # The reader gives as many bytes as the file has, less a byte order mark, and one for a brace that the last row doesn't have.
        rows[-1]["cut_off"] = sum(r["n"] for r in ranges) - ranges[0]["size"] in (1, -2)
        kinds = [("path", pa.string()), ("start", pa.int64()), ("in_string", pa.bool_()), ("stack", pa.list_(pa.string())), ("began", pa.int64()), ("cut_off", pa.bool_())]
        return pa.Table.from_pylist(rows, schema=pa.schema(kinds))

    return carry


def cut(data: bytes, in_string: bool, stack: list, parent: list[str]) -> tuple[list[tuple[int, int]], int | None, int | None, bool, list]:
    """Items of a piece of text: (begin, end) of the complete ones, the end of the one that was open before, the begin of the one left open, and the state after it."""
    e = events(np.frombuffer(data, np.uint8), in_string)
    level, depth = len(parent) + 1, e.depth + len(stack)
    before = depth - e.step
    # Containers around items open and close seldom; between such events either all objects of the level are items or none is.
    around = np.flatnonzero(np.minimum(depth, before) < level)
    inside = np.zeros(len(depth), bool)
    now, last = list(stack), 0
    for i in around.tolist():
        inside[last:i] = fits(now, parent)
        now = [*now[: max(0, int(before[i]))], entry(data, e.quotes, int(e.at[i]))] if e.step[i] > 0 else now[: max(0, int(depth[i]))]
        last = i
    inside[last:] = fits(now, parent)
    mine = np.flatnonzero((np.minimum(depth, before) == level) & inside)
    places, step = e.at[mine], e.step[mine]
    head = None
    if len(stack) > level and fits(stack, parent) and len(step) and step[0] < 0:
        head, places, step = int(places[0]) + 1, places[1:], step[1:]
    begins, ends = places[step > 0], places[step < 0] + 1
    tail = int(begins[len(ends)]) if len(begins) > len(ends) else None
    _, after = followed(list(stack), *left_open(data, e))
    return list(zip(begins.tolist(), ends.tolist(), strict=False)), head, tail, e.in_string, after


def _pieces(parent: list[str]):
    """Items, and pieces of those that lie in several ranges: path, start, number, began (of pieces), ends (whether it holds the item's end), item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, in_string, stack, began, number, part, doubtful = None, False, [], None, 0, [], None

        def rest() -> list[tuple]:
            """What the range leaves open."""
            return [(*now, number, now[1] if began is None else began, False, b"".join(part))] if now is not None and part else []

        for batch in batches:
            states = [batch.column(c) for c in ("path", "start", "in_string", "stack", "began", "cut_off")]
            out, first = [], 0
            for path, start, data in _rows(batch):
                if now != (path, start):
                    out += rest()
                    while states[0][first].as_py() != path or states[1][first].as_py() != start:
                        first += 1
                    in_string, stack, began, cut_off = (c[first].as_py() for c in states[2:])
                    now, number, part, is_open, doubtful = (path, start), 0, [], began is not None, None
                else:
                    is_open = bool(part)
                    out += [doubtful] if doubtful else []
                    doubtful = None
                items, head, tail, in_string, stack = cut(data, in_string, stack, parent)
                if is_open:
                    part.append(data[:head])
                    if head is not None:
                        out.append((*now, number, began, True, b"".join(part)))
                        began, part, number = None, [], number + 1
                for a, b in items:
                    out.append((*now, number, None, True, data[a:b]))
                    number += 1
                if cut_off and (head == len(data) or items and items[-1][1] == len(data)):
                    doubtful = out.pop()  # ends with the file, by a brace that isn't there
                if tail is not None:
                    part = [data[tail:]]
            if out:
                yield _table(out)
        if out := rest():
            yield _table(out)

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("path", pa.string()), ("start", pa.int64()), ("number", pa.int64()), ("began", pa.int64()), ("ends", pa.bool_()), ("item", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def json_items(spark: SparkSession, paths: str | list[str], item_path: str) -> DataFrame:
    """path, start, number, item: the JSON text of every item at a path of every file; start (where the item's range begins in the file) and number order those of a file."""
    *parent, last = item_path.split(".")
    if last != "item":
        raise ValueError("the path of items ends with item")
    rows = spark.read.option("lineSep", "}").text(paths)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    cases = ", ".join(f"out{i} boolean, closed{i} long, opened{i} array<string>" for i in (0, 1))
    summaries = rows.mapInArrow(_summaries, f"{RANGES}, size long, n long, {cases}")
    states = summaries.groupBy("path").applyInArrow(_carried(parent), f"{RANGES}, in_string boolean, stack array<string>, began long, cut_off boolean")
    # One small row a range goes to every task, so that the ranges keep their order and their place.
    found = rows.drop("size").join(F.broadcast(states), ["path", "start"]).mapInArrow(_pieces(parent), f"{RANGES}, number long, began long, ends boolean, item binary")
    whole = found.where("began is null").select("path", "start", "number", "item")
    # The pieces of an item share the range it began in, and come in the order of their ranges.
    parts = found.where("began is not null").groupBy("path", "began").agg(F.array_sort(F.collect_list(F.struct("start", "number", "item"))).alias("p"), F.bool_or("ends").alias("ends")).where("ends")
    joined = parts.select("path", F.col("began").alias("start"), F.col("p")[0]["number"].alias("number"), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["item"])).alias("item"))
    return whole.unionByName(joined).withColumn("item", F.col("item").cast("string")).where(F.col("item").startswith("{"))


def law_articles(spark: SparkSession, paths: str | list[str], item_path: str = "law_sources.articles.item") -> DataFrame:
    """Articles of law files that are too large for one task: path, article_number, content, keywords, order_index (stated, else 0). Articles without text or without number are left out."""
    article = F.from_json("item", "struct<article:string,text:string,keywords:array<string>,order_index:long>").alias("a")
    return (
        json_items(spark, paths, item_path).select("path", article).where("length(a.text) > 0 and length(a.article) > 0")
        .select("path", F.col("a.article").alias("article_number"), F.col("a.text").alias("content"), F.col("a.keywords").alias("keywords"), F.coalesce("a.order_index", F.lit(0)).alias("order_index"))
    )


def write_arrays(rows: DataFrame, path: str) -> None:
    """Rows as JSON arrays of objects, one a file."""

    def arrays(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            texts = [("," if begun or i else "[") + t for i, t in enumerate(batch.column(0).to_pylist())]
            begun = begun or bool(texts)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if begun else "[]"])], names=["value"])

    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(arrays, "value string").write.text(path)
