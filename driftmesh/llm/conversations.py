"""Conversation structure repair: damage, judge and mend the rows of conversations.

Conversations are dealt by id and sorted in their tasks, which read them as a stream and
hold one at a time. A conversation too long for that is cut into pieces by ranges of its
rows' order. What the rows of a piece cost from each state to each is a small matrix;
the matrices of a conversation, combined from its end, give the costs after each piece,
with which pieces are mended beside each other, from every state that they may begin in.
Which state it is follows from the piece before, and only that choice runs through the
pieces, as does the hash of the repaired text, which one task reads as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from driftmesh.llm.arrow import _struct
from driftmesh.llm.automaton import ROLES, START, STATES, Costs, span, symbol
from driftmesh.llm.columns import BLANKS, key128
from driftmesh.storage import materialize

#: A conversation of more rows, or of more characters, is cut into pieces.
LONG_ROWS, LONG_CHARS = 1 << 15, 1 << 25
ALLOWED = {"su", "ua", "au"}
STOPS = ".!?"
TALLIES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
Row = tuple[int | None, str, str]


@lru_cache(maxsize=1)
def _costs() -> Costs:
    return Costs()


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copy, dropped: rows damaged by a hash of their conversation and turn.

    Null roles and texts become one space, as do null ids and turns in the hash. A
    dropped row stays, marked, so that its conversation is not lost.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)])
    named = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"),
        F.coalesce(text_col, F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("kind"),
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return named.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("kind") == 0).alias("dropped"))


def intact(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """As ``damage``, with the rows as they are."""
    return rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"),
        F.coalesce(text_col, F.lit(" ")).alias("text"), F.lit(0).alias("copy"), F.lit(False).alias("dropped"),
    )


def judge(rows: list[Row]) -> tuple[list[int], dict[str, int]]:
    """The symbols of rows in order, and the tallies of their faults."""
    seen, symbols = set(), []
    found = dict.fromkeys(TALLIES, 0)
    for _, role, text in rows:
        body = text.strip(BLANKS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in STOPS else None
        if fault:
            found[fault] += 1
        seen.add((role, text))
        symbols.append(symbol(role, fault in ("blank", "duplicate"), fault == "truncated"))
    found["illegal"] = _illegal([role[:1] for _, role, _ in rows])
    turns = [turn for turn, _, _ in rows if turn is not None]
    found["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return symbols, found


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ALLOWED for a, b in zip(initials, initials[1:], strict=False))


def apply_edits(rows: Iterable[Row], letters: str, state: int) -> Iterator[tuple[str, str]]:
    """role, text of the rows that stay or are put in; ``letters`` run from ``state`` on."""
    rest = iter(rows)
    for letter in letters:
        _, role, text = (None, "", "") if letter == "I" else next(rest)
        if letter == "D":
            continue
        state = {"s": 1, "u": 2, "a": 3}[role[:1]] if letter == "K" else (2, 2, 3, 2)[state]
        yield (role if letter == "K" else ROLES[state], text)


def mend(rows: list[Row]) -> tuple[dict[str, int], str, list[tuple[str, str]]]:
    """Tallies, the edits' letters, and the repaired rows of one conversation."""
    symbols, found = judge(rows)
    found["cost"], path = _costs().cheapest(symbols)
    audit = "".join(letters for letters, _ in path)
    return found, audit, list(apply_edits(rows, audit, START))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Row]]]:
    """Conversations one after the other, from rows sorted by them; dropped rows are left out."""
    name, rows, begun = None, [], False
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped")]
        for conv, turn, role, text, dropped in zip(*columns, strict=True):
            if begun and conv != name:
                yield name, rows
                rows = []
            name, begun = conv, True
            if not dropped:
                rows.append((turn, role, text))
    if begun:
        yield name, rows


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "copy")


def _emit(made: Iterator[tuple], arrow: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in made:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, arrow)
            held = []
    if held:
        yield _batch(held, arrow)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def _kind(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def _report_schema(rows: DataFrame) -> str:
    return f"conv_id {_kind(rows)}, {', '.join(f'{t} long' for t in TALLIES)}, audit string, repaired_sha256 string"


def _reports(rows: DataFrame) -> DataFrame:
    """A report for each conversation that a task can hold."""
    schema = _report_schema(rows)
    arrow = to_arrow_schema(_struct(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for name, own in _streamed(batches):
                found, audit, repaired = mend(own)
                text = "\n".join(f"{role}:{body}" for role, body in repaired)
                yield (name, *found.values(), audit, hashlib.sha256(text.encode()).hexdigest())

        yield from _emit(made(), arrow)

    return _sorted(rows).mapInArrow(run, schema)


def _mended(rows: DataFrame) -> DataFrame:
    schema = f"conv_id {_kind(rows)}, place long, role string, text string"
    arrow = to_arrow_schema(_struct(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((name, k, *row) for name, own in _streamed(batches) for k, row in enumerate(mend(own)[2]))
        yield from _emit(made, arrow)

    return _sorted(rows).mapInArrow(run, schema)


def split_long(rows: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that a task can hold, and those of longer ones, if there are any."""
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))
    long = materialize(sizes.filter((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select(F.col("conv_id").alias("__long")), "long-conversations")
    if long.isEmpty():
        return rows, None
    same = F.col("conv_id").eqNullSafe(F.col("__long"))
    return rows.join(long, same, "left_anti"), rows.join(long, same, "left_semi")


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``rows`` come from ``damage`` or ``intact``. They are taken by turn, nulls first; of
    equal turns by role and text, copies next to each other. Rows without an id are one
    conversation; a role without a first letter s, u or a cannot be kept; repeated rows
    are duplicates; a conversation without rows has zeros and an empty audit. Other
    columns are not carried, so no name can clash. An empty table gives an empty one.
    """
    short, long = split_long(rows, long_rows, long_chars)
    reports = _reports(short)
    return reports if long is None else reports.unionAll(Pieces(long).reports())


def repaired_rows(rows: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> DataFrame:
    """conv_id, place, role, text: the conversations as repaired; places grow with the order."""
    short, long = split_long(rows, long_rows, long_chars)
    return _mended(short) if long is None else _mended(short).unionAll(Pieces(long).lines().select("conv_id", "place", "role", "text"))


class Pieces:
    """Conversations of any length, mended piece by piece."""

    def __init__(self, rows: DataFrame):
        self.kind = _kind(rows)
        self.names = rows.select("conv_id").distinct()
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "copy"]
        dealt = rows.filter(~F.col("dropped")).repartitionByRange(n, *order).sortWithinPartitions(*order)
        # the number grows with the range and the place in it, so with the order of all rows
        dealt = dealt.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("at"))
        self.rows = materialize(self._judged(materialize(dealt, "pieces")), "judged-pieces")

    @staticmethod
    def _judged(dealt: DataFrame) -> DataFrame:
        """Rows with fault and symbol; a duplicate is one whose text was first seen at an earlier place."""
        h1, h2 = key128(F.col("text"))
        keyed = dealt.withColumns({"h1": h1, "h2": h2})
        first = keyed.groupBy("conv_id", "role", "h1", "h2").agg(F.min("at").alias("first")).toDF("c", "r", "k1", "k2", "first")
        same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
        body = F.btrim("text", F.lit(BLANKS))
        fault = F.when(body == "", "blank").when(F.col("at") > F.col("first"), "duplicate").when(~F.right(body, F.lit(1)).isin(*STOPS), "truncated")
        initial = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k, s in (("s", 1), ("u", 2), ("a", 3)) for v in (k, s)]), F.left("role", F.lit(1))), F.lit(0))
        marked = keyed.join(first, same).withColumn("fault", fault)
        coded = F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(1 + 2 * initial + F.coalesce(F.col("fault") == "truncated", F.lit(False)).cast("int"))
        return marked.select("conv_id", "turn", "role", "text", "piece", "at", "fault", coded.alias("symbol"))

    def _each(self, rows: DataFrame, function, schema: str) -> DataFrame:
        """``function`` on the table of each piece."""
        return rows.groupBy("conv_id", "piece").applyInArrow(function, f"conv_id {self.kind}, piece int, {schema}")

    def _spans(self) -> DataFrame:
        """Costs from each state to each, illegal pairs, first and last initial of each piece."""
        made = to_arrow_schema(_struct(f"conv_id {self.kind}, piece int, costs array<long>, illegal long, first string, last string"))

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("at")
            initials = [r[:1] for r in table["role"].to_pylist()]
            costs = [c for row in span(table["symbol"].to_pylist()) for c in row]
            row = (table["conv_id"][0].as_py(), table["piece"][0].as_py(), costs, _illegal(initials), initials[0], initials[-1])
            return pa.Table.from_batches([_batch([row], made)])

        return self._each(self.rows.select("conv_id", "piece", "at", "role", "symbol"), run, "costs array<long>, illegal long, first string, last string")

    def _ends(self) -> DataFrame:
        """piece, end: the costs after each piece, less their smallest; cost and illegal of the conversation."""
        schema = f"conv_id {self.kind}, piece int, end array<long>, cost long, illegal long"
        made = to_arrow_schema(_struct(schema))

        def run(table: pa.Table) -> pa.Table:
            pieces = table.sort_by("piece").to_pylist()
            after, total, rows = list(_costs().vectors[_costs().end]), 0, []
            for piece in reversed(pieces):
                rows.append((piece["conv_id"], piece["piece"], after))
                before = [min(piece["costs"][4 * q + to] + after[to] for to in STATES) for q in STATES]
                total += min(before)
                after = [c - min(before) for c in before]
            illegal = sum(p["illegal"] for p in pieces) + sum(a["last"] + b["first"] not in ALLOWED for a, b in zip(pieces, pieces[1:], strict=False))
            return pa.Table.from_batches([_batch([(*row, total + after[START], illegal) for row in rows], made)])

        return self._spans().groupBy("conv_id").applyInArrow(run, schema)

    def _traced(self, ends: DataFrame) -> DataFrame:
        """entry, leave, audit of each piece and each state that it may begin in."""
        made = to_arrow_schema(_struct(f"conv_id {self.kind}, piece int, entry int, leave int, audit string"))

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("at")
            paths, _, _ = _costs().scan(table["symbol"].to_pylist(), _costs().number(tuple(table["end"][0].as_py())))
            rows = []
            for entry in STATES:
                state, audit = entry, []
                for path in paths:
                    letters, state = path[state]
                    audit.append(letters)
                rows.append((table["conv_id"][0].as_py(), table["piece"][0].as_py(), entry, state, "".join(audit)))
            return pa.Table.from_batches([_batch(rows, made)])

        known = ends.select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), "end")
        placed = self.rows.select("conv_id", "piece", "at", "symbol").join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")))
        return self._each(placed, run, "entry int, leave int, audit string")

    def _chosen(self) -> tuple[DataFrame, DataFrame]:
        """The edits of each piece from the state that it does begin in (the last piece with what follows it), and ``_ends``."""
        ends = materialize(self._ends(), "piece-ends")
        traced = materialize(self._traced(ends), "piece-edits")
        schema = f"c {self.kind}, p int, e int, final string"
        made = to_arrow_schema(_struct(schema))

        def run(table: pa.Table) -> pa.Table:
            leaves = {(r["piece"], r["entry"]): r["leave"] for r in table.to_pylist()}
            state, rows, name = START, [], table["conv_id"][0].as_py()
            pieces = sorted({piece for piece, _ in leaves})
            for piece in pieces:
                entry, state = state, leaves[piece, state]
                rows.append((name, piece, entry, _costs().last[state][0] if piece == pieces[-1] else ""))
            return pa.Table.from_batches([_batch(rows, made)])

        ways = traced.select("conv_id", "piece", "entry", "leave").groupBy("conv_id").applyInArrow(run, schema)
        same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")) & (F.col("entry") == F.col("e"))
        chosen = traced.join(ways, same).select("conv_id", "piece", "entry", F.concat("audit", "final").alias("audit"))
        return materialize(chosen, "piece-choices"), ends

    def _lines(self, chosen: DataFrame) -> DataFrame:
        made = to_arrow_schema(_struct(f"conv_id {self.kind}, piece int, place long, role string, text string"))

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("at")
            name, piece, base = (table[c][0].as_py() for c in ("conv_id", "piece", "at"))
            own = zip(*[table[c].to_pylist() for c in ("turn", "role", "text")], strict=True)
            edited = apply_edits(own, table["audit"][0].as_py(), table["entry"][0].as_py())
            rows = [(name, piece, base + k, *line) for k, line in enumerate(edited)]  # the next piece's rows are numbered far above
            return pa.Table.from_batches([_batch(rows, made)] if rows else [], made)

        known = chosen.select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), "entry", "audit")
        placed = self.rows.select("conv_id", "piece", "at", "turn", "role", "text").join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")))
        return self._each(placed.drop("c", "p"), run, "place long, role string, text string")

    def lines(self) -> DataFrame:
        """conv_id, piece, place, role, text of the repaired conversations."""
        return self._lines(self._chosen()[0])

    def reports(self) -> DataFrame:
        chosen, ends = self._chosen()
        line = F.concat("role", F.lit(":"), "text").alias("line")
        hashed = self._hashed(self._lines(chosen).select("conv_id", "place", line)).toDF("c2", "repaired_sha256")
        faults = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
        turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        tallies = self.rows.groupBy("conv_id").agg(F.coalesce(turns, F.lit(0).cast("long")).alias("gaps"), *faults).withColumnRenamed("conv_id", "c1")
        costs = ends.groupBy("conv_id").agg(F.first("cost").alias("cost"), F.first("illegal").alias("illegal")).withColumnRenamed("conv_id", "c3")
        parts = F.array_sort(F.collect_list(F.struct("piece", "audit")))
        audits = chosen.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit")).withColumnRenamed("conv_id", "c4")
        joined = self.names
        for part, name in ((tallies, "c1"), (hashed, "c2"), (costs, "c3"), (audits, "c4")):
            joined = joined.join(part, F.col("conv_id").eqNullSafe(F.col(name)), "left")
        numbers = [F.coalesce(t, F.lit(0).cast("long")).alias(t) for t in TALLIES]
        empty = F.lit(hashlib.sha256(b"").hexdigest())
        return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))

    def _hashed(self, lines: DataFrame) -> DataFrame:
        """The hash of each conversation's lines; a hash has one order, so each is read by one task, as a stream."""
        schema = f"conv_id {self.kind}, repaired_sha256 string"
        arrow = to_arrow_schema(_struct(schema))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def made() -> Iterator[tuple]:
                name, state = None, None
                for batch in batches:
                    for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                        if state is None or conv != name:
                            if state is not None:
                                yield name, state.hexdigest()
                            name, state = conv, hashlib.sha256(line.encode())
                        else:
                            state.update(b"\n" + line.encode())
                if state is not None:
                    yield name, state.hexdigest()

            yield from _emit(made(), arrow)

        return lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, schema)
