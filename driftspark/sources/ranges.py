"""Large files read by many tasks: lines with their numbers, pieces of scripts, records of quoted exports.

Spark's text reader splits a file into byte ranges at line ends. What a line means depends on all before it: it may lie in a
literal, a dollar-quoted body, a comment or a quoted field. So every range is read as a function from the state it begins in
to the state it ends in, for the states that ranges of the same file can end in; the functions are composed over the ranges
of a file, which tells each range its state; then it is cut. What is cut off at the edges of ranges is put together again.

All reading goes through Spark, so a path may be in any store that Spark knows.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Executors get these functions with the query, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The state outside of everything. Others are texts that say what is open.
OUTSIDE = ""
#: Characters of a script piece, beyond which it ends before the next routine statement; of lines that go to a task together.
PIECE, CHUNK = 1 << 18, 1 << 20

_TOKEN = re.compile(r"""--|/\*|(?<![\w$])\$(?:[^\W\d]\w*)?\$|['"]""")
_EDGE = re.compile(r"/\*|\*/")
_PLAIN_END = {"'": re.compile(r"[^']*+(?:''[^']*+)*+'"), '"': re.compile(r'[^"]*+(?:""[^"]*+)*+"')}
_ESCAPED_END = re.compile(r"[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'")
_ESCAPE = re.compile(r"(?<![\w$])[eE]\Z")
_STATEMENT = re.compile(r"[ \t]*(?:CREATE\s+(?:OR\s+REPLACE\s+)?|COMMENT\s+ON\s+)(?:FUNCTION|PROCEDURE)(?=\s|\Z)", re.I)

Lexer = Callable[[str, str], str]
#: A comment so deep that a range does not end it; that range's function has how many more it opens than it ends.
DEEP = "/+"


def script_state(state: str, line: str, pos: int = 0) -> str:
    """The state behind a line of SQL text, from `pos` on: a quote, E and a quote, a dollar tag, or a slash for each open comment."""
    while True:
        if state == OUTSIDE:
            token = _TOKEN.search(line, pos)
            if not token or token[0] == "--":
                return OUTSIDE
            pos, state = token.end(), token[0]
            if state == "/*":
                state = "/"
            elif state == "'" and _ESCAPE.search(line, max(token.start() - 2, 0), token.start()):
                state = "E'"
        elif state[0] == "/":
            edge = _EDGE.search(line, pos)
            if not edge:
                return state
            pos, state = edge.end(), state + "/" if edge[0] == "/*" else state[1:]
        elif state[0] == "$":
            pos = line.find(state, pos)
            if pos < 0:
                return state
            pos, state = pos + len(state), OUTSIDE
        else:
            end = (_ESCAPED_END if state == "E'" else _PLAIN_END[state]).match(line, pos)
            if not end:
                return state
            pos, state = end.end(), OUTSIDE


def record_state(state: str, line: str) -> str:
    """The state behind a line of a ``|``-separated export: within a quoted field, or outside."""
    pos = 0
    while True:
        if state == OUTSIDE:
            if not pos and line.startswith('"'):
                pos = 1
            else:
                pos = line.find('|"', max(pos - 1, 0)) + 2
                if pos < 2:
                    return OUTSIDE
            state = '"'
        else:
            pos = line.find('"', pos)
            if pos < 0:
                return state
            if line.startswith('""', pos):
                pos += 2
            else:
                pos, state = pos + 1, OUTSIDE


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, block, line): lines without their ends, by byte range; the empty line behind the last end is not there."""
    read = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    meta = lambda name: F.col(f"_metadata.{name}")
    return read.select(meta("file_path").alias("file"), meta("file_size").alias("size"), meta("file_block_start").alias("block"), F.col("value").alias("line"))


def _staged(df: DataFrame) -> DataFrame:
    """Written to the folder that the session names in spark.checkpoint.dir; where it names none, as in tests, beside the warehouse."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints-{uuid.uuid4().hex}")
    return df.checkpoint()


def _chunks(lines: DataFrame) -> DataFrame:
    """(file, block, n, last, text): the lines of each range in chunks of some size, which know their order, so that they may
    be shuffled. Lines come as the reader gives them: those of a range follow one another in a task."""

    def run(batches):
        held, size, key, n = [], 0, None, 0

        def row(last):
            columns = zip((*key, n, last, "\n".join(held)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["file", "block", "n", "last", "text"])

        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns)):
                if key is not None and (key != (file, block) or size > CHUNK):
                    yield row(key != (file, block))
                    held, size, n = [], 0, 0 if key != (file, block) else n + 1
                key = file, block
                held.append(line)
                size += len(line) + 1
        if key is not None:
            yield row(True)

    return lines.select("file", "block", "line").mapInArrow(run, "file string, block long, n long, last boolean, text string")


def _in_order(chunks: DataFrame, more: DataFrame, on: list[str]) -> DataFrame:
    """Chunks with the columns of `more`; those of a range stay together, in order, however Spark joins them."""
    keyed = chunks.join(more, on)
    if on == ["file"]:  # by file alone, a shuffle would put all ranges of a file into one task
        ranges = chunks.select("file", "block").distinct().join(more, on)
        keyed = chunks.join(ranges, ["file", "block"])
    return keyed.sortWithinPartitions("file", "block", "n")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of text files of any size; the line behind the last line end counts, as in a text cut at line ends.

    Each range numbers its own lines; the ranges before it add theirs. Empty files have no rows, as Spark skips them.
    """
    rows = _lines(spark, path)

    def number(batches):
        numbers: dict = {}
        for batch in batches:
            at = []
            for key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                numbers[key] = n = numbers.get(key, -1) + 1
                at.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "at"])

    per_block = rows.groupBy("file", "size", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line") + F.lit(1)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = per_block.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = rows.mapInArrow(number, "file string, size long, block long, line string, at long")
    lines = numbered.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("at")).cast("int").alias("pos"), "line")
    # All bytes are lines and their ends: the last line has an end if nothing is missing.
    whole = per_block.groupBy("file", "size").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    last = whole.where("bytes = size").select("file", F.col("n").cast("int").alias("pos"), F.lit("").alias("line"))
    return lines.unionByName(last)


def _state_functions(chunks: DataFrame, lexer: Lexer, starts: list[str]) -> DataFrame:
    """(file, block, begin, end): where each range goes from each state: from `starts`, and from the dollar tags that ranges
    of its file end in, until none ends in a new one. Comments of any depth are read at once: where one of depth d ends in
    a range, the rest is read from there, and DEEP tells what happens to deeper ones.
    """

    def run(batches):
        now: dict[str, str] = {}
        offset = least = 0
        for row in (row for batch in batches for row in batch.to_pylist()):
            now = now or {b: b for b in row["begins"]}
            for line in row["text"].split("\n"):
                # Most states meet after a few lines, and are one from there on.
                moved = {s: lexer(s, line) for s in set(now.values()) - {DEEP}}
                now = {b: moved.get(s, s) for b, s in now.items()}
                if DEEP in now:
                    for edge in _EDGE.finditer(line):
                        offset += 1 if edge[0] == "/*" else -1
                        if offset < least:
                            least = offset
                            now["/" * -least] = lexer(OUTSIDE, line, edge.end())
            if row["last"]:
                now.update({DEEP: str(offset)} if DEEP in now else {})
                columns = [[row["file"]] * len(now), [row["block"]] * len(now), list(now), list(now.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["file", "block", "begin", "end"])
                now, offset, least = {}, 0, 0

    states = F.array(*[F.lit(s) for s in starts])
    begins = chunks.select("file").distinct().select("file", states.alias("begins"))
    done = None
    while True:
        found = _staged(_in_order(chunks, begins, ["file"]).mapInArrow(run, "file string, block long, begin string, end string"))
        done = found if done is None else done.unionByName(found)
        tags = done.where("startswith(end, '$')").select("file", F.col("end").alias("state")).distinct()
        new = tags.join(done.select("file", F.col("begin").alias("state")).distinct(), ["file", "state"], "left_anti")
        begins = _staged(new.groupBy("file").agg(F.collect_set("state").alias("begins")))
        if begins.isEmpty():
            return done


def _after(step: dict[str, str], state: str) -> str:
    """The state behind a range that begins in `state`."""
    if state not in step and state.startswith("/"):
        return "/" * (len(state) + int(step[DEEP]))
    return step[state]


def _begins(chunks: DataFrame, lexer: Lexer, starts: list[str]) -> DataFrame:
    """(file, block, state, open): the state that each range begins in, and whether its file ends within something.

    Files of one range begin outside; they are read as they are, also if they end within something.
    """
    blocks = _staged(chunks.where("last").select("file", "block"))
    ranges = blocks.groupBy("file").agg(F.count(F.lit(1)).alias("ranges"))
    several = _staged(blocks.join(ranges.where("ranges > 1"), "file").select("file", "block"))
    functions = _state_functions(chunks.join(several, ["file", "block"], "left_semi"), lexer, starts)

    def compose(table: pa.Table) -> pa.Table:
        """The ranges of one file, a row for each and each state: as many as it has ranges, whatever they hold."""
        steps: dict[int, dict[str, str]] = {}
        for row in table.to_pylist():
            steps.setdefault(row["block"], {})[row["begin"]] = row["end"]
        state, begins = OUTSIDE, {}
        for block in sorted(steps):
            begins[block] = state
            state = _after(steps[block], state)
        n = len(begins)
        return pa.table({"file": [table["file"][0].as_py()] * n, "block": list(begins), "state": list(begins.values()), "open": [state != OUTSIDE] * n})

    known = functions.groupBy("file").applyInArrow(compose, "file string, block long, state string, open boolean")
    alone = blocks.join(several, ["file", "block"], "left_anti").select("file", "block", F.lit(OUTSIDE).alias("state"), F.lit(False).alias("open"))
    return known.unionByName(alone)


def _pieces(chunks: DataFrame, begins: DataFrame, lexer: Lexer, cut: Callable[[str], bool], most: int) -> DataFrame:
    """(file, piece, text): texts that begin at lines where a cut may be, in state OUTSIDE, and are longer than `most` where
    that is possible. `piece` counts up within a file. A file that ends within something is one piece."""

    def run(batches):
        state, head, held, size, n, out = OUTSIDE, True, [], 0, 0, []

        def flush(kind):
            nonlocal held, size, n
            if held:
                out.append((file, block, n, kind, "\n".join(held)))
                n += 1
                held, size = [], 0

        current = None
        for row in (row for batch in batches for row in batch.to_pylist()):
            if current != (row["file"], row["block"]):
                current = file, block = row["file"], row["block"]
                state, head, held, size, n = row["state"], True, [], 0, 0
            for line in row["text"].split("\n"):
                if state == OUTSIDE and not row["open"] and (head or size > most) and cut(line):
                    flush("head" if head else "piece")
                    head = False
                held.append(line)
                size += len(line) + 1
                state = lexer(state, line)
            if row["last"]:
                flush("head" if head else "tail")
                current = None
            if out:
                columns = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["file", "block", "n", "kind", "text"]
                )
                out = []

    cut_up = _in_order(chunks, begins, ["file", "block"])
    rows = _staged(cut_up.mapInArrow(run, "file string, block long, n long, kind string, text string"))
    number = lambda block, n: F.struct(F.col(block).alias("block"), F.col(n).alias("n"))
    whole = rows.where("kind = 'piece'").select("file", number("block", "n").alias("piece"), "text")
    # What a range begins with goes on where the last one left off; a tail opens a piece.
    order = Window.partitionBy("file").orderBy("block", "n")
    edges = rows.where("kind <> 'piece'").withColumn("group", F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(order))
    joined = edges.groupBy("file", "group").agg(F.min(number("block", "n")).alias("piece"), F.sort_array(F.collect_list(F.struct("block", "n", "text"))).alias("parts"))
    return whole.unionByName(joined.select("file", "piece", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text")))


def script_pieces(spark: SparkSession, path: str, most: int = PIECE) -> DataFrame:
    """(path, piece, text): SQL files below `path` in pieces, cut before lines that begin a routine statement.

    The statements of a file are those of its pieces in order of `piece`; `operators.routines.renumbered` counts their
    positions by file. Comments may be in other pieces than what they are on, so they are attached by file. A file that
    ends within a literal or comment is one piece, as what is open there decides how all of it is read.
    """
    chunks = _chunks(_lines(spark, path))
    pieces = _pieces(chunks, _begins(chunks, script_state, [OUTSIDE, "'", '"', "E'", DEEP]), script_state, lambda line: bool(_STATEMENT.match(line)), most)
    return pieces.withColumnRenamed("file", "path")


def export_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, piece, text): the records of ``|``-separated quoted files, without their line ends; empty lines are none."""
    chunks = _chunks(_lines(spark, path))
    return _pieces(chunks, _begins(chunks, record_state, [OUTSIDE, '"']), record_state, lambda line: True, -1).where("text <> ''")
