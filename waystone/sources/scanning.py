"""Feature files in any layout, read side by side in chunks.

A file is cut at feature marks into chunks of bounded size. A chunk is a function on the state
of the reader: where it stands (open brackets, inside the features of a collection or not, an
unfinished token), without the text it holds. Every chunk runs from the state that the
file's first chunk ends in, which is nearly always right, since all cuts lie at the same place
of a feature. The ends are then compared with the states the next chunks ran from, and
chunks that ran from a wrong one run again, until the chain of states agrees; every round makes at
least one more chunk of each file final. What is open at the end of a chunk is put together
with the chunks that finish it, object by object.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stage import stage
from ..session import scratch_path

MARK = '"Feature"'
#: Characters of a chunk (one longer piece is its own chunk).
CHUNK_CHARS = 2 << 20
#: Chunks of a stored file, so that many tasks share them.
CHUNKS_A_FILE = 8

CHUNK = "_file string, _start bigint, _part bigint, text string"
SCANNED = (
    "_file string, no bigint, round int, seq bigint, kind string, text string, age bigint, "
    "from string, to string"
)
KEY = ["_file", "_start", "_part"]


def scanner(mark: str = MARK, at_once: bool = True) -> Callable:
    """``scan(text, state, last) -> (rows, state)``; rows are (kind, text, age).

    ``state`` is None at the start of a file. ``age`` counts the chunks since the text began.
    Kinds: ``row`` a finished text; ``early`` a stray text before any object of the file;
    ``object``, ``broken``, ``stray`` the end of a text that began in an earlier chunk;
    ``open`` what a later chunk finishes; ``none`` the end of a file without any object.
    Sound objects are taken ``at_once`` by the JSON decoder, which only looks for their ends; all
    else, and any object that may be a collection, goes token by token, with the same rows.
    All in one closure, so that Python workers need not import this package.
    """
    import json
    import re

    token = re.compile(r'"(?:[^"\\\n]|\\[^\n])*"|[{}\[\]:,\n"]|[^\s{}\[\]:,"]+')
    told_apart = {":", "[", ",", '"features"'}
    blank = "\ufeff\x1e \t\r"

    class Scan:
        def __init__(self, state):
            s = json.loads(state) if state else {}
            self.carry = s.get("carry", "")
            self.stack = list(s.get("stack", ""))
            self.before, self.key = s.get("before", ""), s.get("key", "")
            self.inside = s.get("inside", False)  # in the features of a collection
            self.any = s.get("any", False)  # something was found
            self.base = s.get("base", 0)
            self.after = s.get("after", False)  # behind the features of a collection
            self.bad = s.get("bad", False)  # in a string without an end
            self.age = s.get("age", 0)  # chunks since the open text began, 0 if in this one
            self.held, self.out, self.stray = [], [], []
            self.trust = 64
            self.decode = json.JSONDecoder(parse_int=len, parse_float=len).raw_decode  # no number is kept

        def state(self):
            return json.dumps(
                {
                    "carry": self.carry, "stack": "".join(self.stack), "before": self.before,
                    "key": self.key, "inside": self.inside, "any": self.any, "base": self.base,
                    "after": self.after, "bad": self.bad, "age": self.age,
                }
            )

        def open(self):
            return len(self.stack) > self.base

        def finish(self, kind, parts):
            """The end of the text that is open."""
            text, age = "".join(parts), self.age
            self.age = 0
            if age:
                self.out.append((kind, text, age))
            elif kind == "object":
                self.out.append(("row", text, 0))
            elif kind == "stray":
                if text.strip(blank):
                    self.out.append(("row" if self.any else "early", text, 0))
            else:
                # it is no object: its pieces behind the marks, or all of it
                pieces = text.split(mark)[1:]
                if pieces:
                    self.out += [("row", '{"type":' + mark + x, 0) for x in pieces]
                elif text.strip():
                    self.out.append(("row", text, 0))

        def emit(self):
            self.finish("object", self.held)
            self.held, self.any = [], True

        def broken(self):
            self.finish("broken", self.held)
            self.held, self.any = [], True
            del self.stack[self.base:]

        def strayed(self):
            if self.stray or self.age:
                self.finish("stray", self.stray)
            self.stray = []

        def feed(self, chunk, last=False):
            text, at = self.carry + chunk, 0
            self.carry = ""
            tokens = token.finditer(text)
            while m := next(tokens, None):
                t = m.group()
                if at_once and t == "{" and not self.open():
                    end = self.whole(text, m.start())
                    if end:
                        at, tokens = end, token.finditer(text, end)
                        continue
                if not last and (t == '"' or m.end() == len(text) and t[0] not in '{}[]:,\n"'):
                    if t != '"' or text.find("\n", m.start()) < 0:
                        self.carry = text[m.start():]  # the rest of it is still to come
                        if self.open():
                            self.held.append(text[at:m.start()])
                        return
                gap, at = text[at:m.start()], m.end()
                if self.open():
                    self.held.append(gap)
                self.step(t)
            if self.open():
                self.held.append(text[at:])

        def whole(self, text, start):
            """Take the sound object that begins here -> its end; None if there is none."""
            if self.after or self.bad:  # what is broken before reaches into it
                return None
            if self.trust < 0:  # many objects of this chunk are broken, and each trial costs
                return None
            size = 4096  # an error costs a search for lines from the start of what is decoded
            while True:
                try:
                    found, end = self.decode(text[start:start + size])
                    break
                except (ValueError, RecursionError) as e:
                    at = getattr(e, "pos", 0)
                    cut = at + 16 > size or getattr(e, "msg", "").startswith("Unterminated")
                    if not cut or start + size >= len(text):
                        self.trust -= 8
                        return None
                    size *= 16
            end += start
            if not self.inside:
                if "features" in found:
                    return None
                self.key = "x" if found else self.key
            self.strayed()
            self.trust += 1
            self.held = [text[start:end]]
            self.emit()
            self.before = "x"
            return end

        def step(self, t):
            if self.open():
                self.within(t)
            elif self.inside:
                self.among(t)
            elif t == "{":
                self.strayed()
                self.begin()
            elif t == "\n":
                self.strayed()
            elif t not in "[],":
                self.stray.append(t)
            if t != "\n":
                self.before = t if t in told_apart else "x"

        def begin(self):
            self.stack.append("{")
            self.held = ["{"]

        def among(self, t):
            """Between the features of a collection."""
            if t == "{":
                self.strayed()
                self.begin()
            elif t == "]":
                self.strayed()
                # the rest of the collection is held to find its end, not as an object
                self.inside, self.base = False, 0
                self.stack, self.after = ["{"], True
                self.held = []
            elif t == ",":
                self.strayed()
            elif t != "\n":
                self.stray.append(t)

        def within(self, t):
            misplaced = t == "{" and not self.bad and (
                self.before not in (":", "[", ",") or self.before == "," and self.stack[-1] == "{"
            )
            if misplaced or self.bad and t == "\n":
                if self.after:
                    self.held, self.stack = [], []
                else:
                    self.broken()
                self.after = self.bad = False
                if misplaced:
                    self.begin()
                return
            self.held.append(t)
            self.bad = self.bad or t == '"'
            if self.bad:
                return
            if t in "{[":
                top = len(self.stack) == 1 and self.base == 0
                if t == "[" and top and self.before == ":" and self.key == '"features"':
                    if self.age:  # its text ends here, as nothing
                        self.out.append(("nothing", "", self.age))
                    self.held, self.stack, self.age = [], ["{", "["], 0
                    self.inside, self.base, self.any, self.after = True, 2, True, False
                    return
                self.stack.append(t)
            elif t in "}]":
                if self.stack[-1] != ("{" if t == "}" else "["):
                    self.broken()
                    return
                self.stack.pop()
                if not self.open():
                    if self.after:
                        self.held, self.after = [], False
                    else:
                        self.emit()
            elif t == ":" and len(self.stack) == 1:
                self.key = self.before
            if self.after:
                self.held = []

        def end(self):
            """The end of the file."""
            if self.after:
                self.carry, self.held, self.stack = "", [], []
            elif self.open():  # it is cut
                self.held.append(self.carry)
                self.broken()
            else:
                self.feed("", last=True)
            self.strayed()
            if not self.any:
                self.out.append(("none", None, 0))

        def pause(self):
            """The end of a chunk."""
            if self.after and self.open():
                return
            text = "".join(self.held if self.open() else self.stray)
            if text or self.age:
                self.out.append(("open", text, self.age))
                self.age += 1

    def scan(text, state, last):
        run = Scan(state)
        run.feed(text)
        if last:
            run.end()
        else:
            run.pause()
        return run.out, run.state()

    return scan


def chunks_of(pieces: DataFrame) -> DataFrame:
    """Pieces in reading order (see ``feature_pieces``) -> chunks of whole pieces with their marks."""
    mark, limit = MARK, CHUNK_CHARS

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["_file", "_start", "_part", "text"]
        at, part, held, size = None, 0, [], 0

        def row():
            values = [*at, part, "".join(held)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            arrays = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_file", "_start", "value")]
            for file, start, value in zip(*columns, strict=True):
                if at != (file, start):
                    if at is not None:
                        yield row()
                    first = start == 0  # of the file; all others follow a mark
                    at, part, held, size = (file, start), 0, [], 0
                elif size >= limit:
                    yield row()
                    part, held, size = part + 1, [], 0
                held += [value] if first else [mark, value]
                first = False
                size += len(value) + len(mark)
        if at is not None:
            yield row()

    return pieces.select("value", "_file", "_start").mapInArrow(run, CHUNK)


def _run(chunks: DataFrame, todo: DataFrame, turn: int) -> DataFrame:
    """Scan the chunks in ``todo`` (file, start, part, no, last, from) and store what they give."""
    scan = scanner()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(),
                 pa.int64(), pa.string(), pa.string()]
        names = ["_file", "no", "round", "seq", "kind", "text", "age", "from", "to"]
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                out, state = scan(r["text"], r["from"], r["last"])
                head = [r["_file"], r["no"], turn]
                rows = [[*head, i, *given, None, None] for i, given in enumerate(out)]
                rows.append([*head, len(out), "end", None, 0, r["from"], state])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=names,
                )

    rows = chunks.join(todo, KEY).select("_file", "no", "last", "from", "text")
    return stage(rows.mapInArrow(run, SCANNED), "scan")


def scanned(pieces: DataFrame) -> DataFrame:
    """Pieces (see ``feature_pieces``) -> (_file, chunk, row, text): the members of collections
    and the other outermost objects of each file, in their order and with members in any
    order. Parts that are cut or broken come as they are, or in pieces behind their marks; a
    file without any object is one row without text."""
    spark = pieces.sparkSession
    path = scratch_path(spark, "chunks")
    chunks_of(pieces).write.option("maxRecordsPerFile", CHUNKS_A_FILE).parquet(path)
    chunks = spark.read.schema(CHUNK).parquet(path)
    order = Window.partitionBy("_file").orderBy("_start", "_part")  # of narrow rows
    places = stage(
        chunks.select(
            *KEY, (F.row_number().over(order) - 1).cast("bigint").alias("no"),
            F.lead("_start").over(order).isNull().alias("last"),
        ),
        "places",
    )
    runs = [_run(chunks, places.filter("no = 0").withColumn("from", F.lit(None).cast("string")), 0)]
    rest = places.filter("no > 0")
    latest = None
    if not rest.isEmpty():
        guess = runs[0].filter("kind = 'end'").select("_file", F.col("to").alias("from"))
        runs.append(_run(chunks, rest.join(guess, "_file"), 1))
        chain = Window.partitionBy("_file").orderBy("no")
        while True:
            ends = reduce(DataFrame.union, [r.filter("kind = 'end'") for r in runs])
            newest = ends.groupBy("_file", "no").agg(F.max_by(F.struct("round", "from", "to"), "round").alias("e"))
            linked = newest.select("_file", "no", "e.*").withColumn("before", F.lag("to").over(chain))
            latest = stage(linked, "states")
            wrong = latest.filter((F.col("no") > 0) & (F.col("from") != F.col("before")))
            wrong = wrong.select("_file", "no", F.col("before").alias("from"))
            if wrong.isEmpty():
                break
            if len(runs) % 2:  # mending place by place did not do: the layout may have changed
                wrong = _from_first(latest, wrong)
            runs.append(_run(chunks, places.join(wrong, ["_file", "no"]), len(runs)))
    rows = reduce(DataFrame.union, runs).filter("kind not in ('end', 'nothing')")
    if len(runs) > 2:  # what a chunk gave from a wrong state does not count
        rows = rows.join(latest.select("_file", "no", "round"), ["_file", "no", "round"], "left_semi")
    return _joined(rows)


def _from_first(latest: DataFrame, wrong: DataFrame) -> DataFrame:
    """The first wrong chunk of each file, and all later ones, from the state it starts in."""
    first = wrong.groupBy("_file").agg(F.min_by(F.struct("no", "from"), "no").alias("w"))
    rest = latest.join(first, "_file").filter("no = w.no or no > w.no and from != w.from")
    return rest.select("_file", "no", F.col("w.from").alias("from"))


def _joined(rows: DataFrame) -> DataFrame:
    """Rows of all chunks (see ``scanner``) -> finished texts in order."""
    empty = rows.filter("kind = 'none'").select("_file")
    whole = rows.filter("kind in ('row', 'none')").select("_file", F.col("no").alias("chunk"), F.col("seq").alias("row"), "text")
    early = rows.filter("kind = 'early'").join(empty, "_file", "left_anti")
    early = early.select("_file", F.col("no").alias("chunk"), F.col("seq").alias("row"), "text")
    # what began in a chunk is the last of it, behind all its finished texts
    parts = rows.filter("kind in ('open', 'object', 'broken', 'stray')")
    of_object = parts.groupBy("_file", (F.col("no") - F.col("age")).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("no", "seq", "text"))).alias("parts"),
        F.max_by("kind", F.struct("no", "seq")).alias("kind"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    built = of_object.select("_file", "chunk", "kind", F.explode(F.array(text)).alias("text"))
    marked = F.split("text", MARK)
    pieces = F.transform(
        F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(0))),
        lambda x: F.concat(F.lit('{"type":' + MARK), x),
    )
    whole_text = F.filter(F.array("text"), lambda x: F.btrim(x, F.lit("\ufeff\x1e \t\r\n")) != "")
    texts = (
        F.when(F.col("kind") == "object", F.array("text"))
        .when((F.col("kind") == "broken") & (F.size(marked) > 1), pieces)
        .otherwise(whole_text)
    )
    late = built.filter("kind != 'open'").select("_file", "chunk", "kind", F.posexplode(texts).alias("k", "text"))
    late = late.join(empty, "_file", "left_anti").select(
        "_file", "chunk", (F.lit(1 << 40) + F.col("k")).alias("row"), "text"
    )
    return whole.union(early).union(late)
