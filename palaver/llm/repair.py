"""Least-cost repair of conversations: weighted interval parsing with a normal-form grammar.

A good conversation's role initials match ``(s?(ua)+)?``. The grammar has a nonterminal [p q] for
every piece of this language that leads from state p to state q (start, after s, after u, after a), with
binary rules [p q] -> [p r] [r q] and terminal rules for a row kept, given another role or deleted.
A cell holds for each nonterminal the least (cost, audit) that derives its span of rows;
it is closed under insertions (empty turns before and after). Cells are combined bottom-up by span length.
Since [p q] is closed under concatenation, every split of a span gives the same least cell, so one split a
span is enough: lengths double, and a conversation of n rows takes n combinations. Equal costs go to
the audit that is least in ASCII order; two audits of equal cost for one span never are prefixes of each other.

How it runs: rows are sorted over all partitions by conversation, turn (nulls first), role and text, so a hot conversation is
spread over many tasks. Blocks of rows become cells, cells of a partition and then of groups of
partitions are combined until one is left for each conversation. The hash of a repaired conversation is a stream
over its rows in order, of which no more than a batch is held.

Defined cases: null ids, turns, roles and texts count as one blank each where they are read, and a null
id is a conversation of its own; an empty role has no initial, so it is never kept; empty texts are blank; rows of one turn come by role, then
text; repeated rows are duplicates; very long texts are read once and passed on in the stream; other columns are
not looked at; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from palaver.session import materialize

STATES = 4
#: From state and role initial to the next state: start, after s, after u, after a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
GOOD_PAIRS = ("su", "ua", "au")
#: Faults of a row.
SOUND, BLANK, DUPLICATE, CUT = 0, 1, 2, 3

Cell = tuple  # of STATES x STATES entries, (cost, audit) or None


def _least(options) -> tuple[int, str] | None:
    return min((o for o in options if o is not None), default=None)


def combine(left: Cell, right: Cell) -> Cell:
    """[p q] -> [p r] [r q]"""
    out = []
    for p in range(STATES):
        for q in range(STATES):
            out.append(_least((left[p * STATES + r][0] + right[r * STATES + q][0], left[p * STATES + r][1] + right[r * STATES + q][1])
                              for r in range(STATES) if left[p * STATES + r] is not None and right[r * STATES + q] is not None))
    return tuple(out)


def _closure() -> Cell:
    """Insertions of empty turns between any two states, none included."""
    cell: list = [(0, "") if p == q else None for p in range(STATES) for q in range(STATES)]
    for _ in range(STATES):
        for p in range(STATES):
            for (r, initial), q in STEP.items():
                before = cell[p * STATES + r]
                if initial != "s" and before is not None:
                    cell[p * STATES + q] = _least([cell[p * STATES + q], (before[0] + INSERT, before[1] + "I")])
    return tuple(cell)


CLOSURE = _closure()


@lru_cache(maxsize=4096)
def row_cell(initial: str, fault: int) -> Cell:
    """The closed cell of one row."""
    cell: list = [(DELETE, "D") if p == q else None for p in range(STATES) for q in range(STATES)]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT else 0
        for (p, want), q in STEP.items():
            ways = [cell[p * STATES + q], (extra, "K") if want == initial else None, (REROLE + extra, "R") if want != "s" else None]
            cell[p * STATES + q] = _least(ways)
    return combine(combine(CLOSURE, tuple(cell)), CLOSURE)


def fold(cells: list[Cell]) -> Cell:
    """The cell of neighbouring spans, by doubling lengths."""
    while len(cells) > 1:
        paired = [combine(cells[i], cells[i + 1]) for i in range(0, len(cells) - 1, 2)]
        cells = paired + cells[len(cells) - len(cells) % 2:]
    return cells[0] if cells else CLOSURE


@lru_cache(maxsize=65536)
def _parse(rows: tuple) -> Cell:
    """The cell of a short block of rows (initial, fault)."""
    return fold([row_cell(i, f) for i, f in rows])


def best(cell: Cell) -> tuple[int, str]:
    return _least(cell[q] for q in ACCEPTED)


# --------------------------------------------------------------------- damage and faults

def _text(c: str, blank: str = " ") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(blank))


def damage(rows: DataFrame) -> DataFrame:
    """The rows with planted faults: by the checksum of ``conv_id:turn`` some go, lose text or stops, come twice or become user."""
    code = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    text = (F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace(_text("text"), "[.!?]", "")).otherwise(_text("text")))
    return rows.select("conv_id", "turn", "role", "text", code.alias("code")).where("code <> 0").select(
        "conv_id", "turn", F.when(F.col("code") == 4, F.lit("user")).otherwise(_text("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")).drop("again")


def ordered(rows: DataFrame, prefix: int = 32) -> DataFrame:
    """The rows with ``place``, a number that rises in the order of conversation, turn (nulls first), role and text.

    Ranges of rows make the partitions, so that a large conversation takes several.
    """
    spread = rows.withColumn("_head", F.left("text", F.lit(prefix))).repartitionByRange("conv_id", F.asc_nulls_first("turn"), "role", "_head").drop("_head")
    placed = spread.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").withColumn("place", F.monotonically_increasing_id())
    return materialize(placed, "ordered")


def faults(placed: DataFrame) -> DataFrame:
    """conv_id, turn, place, initial, fault of every row (0 none, 1 blank, 2 duplicate, 3 truncated)."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = placed.select("conv_id", "turn", "place", F.left("role", F.lit(1)).alias("initial"), last.alias("last"),
                         F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))).alias("digest"))
    rows = materialize(rows, "rows")
    twice = rows.groupBy("conv_id", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    known = rows.join(twice, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    fault = (F.when(F.col("last") == "", BLANK).when(F.col("place") > F.col("first"), DUPLICATE).when(~F.col("last").rlike("[.!?]"), CUT).otherwise(SOUND))
    return known.select("conv_id", "turn", "place", "initial", fault.alias("fault"))


# --------------------------------------------------------------------- parsing

PART = "conv_id string, part long, at long, cost array<int>, audit array<string>, head string, tail string, illegal long"
SPAN = 2 ** 33


def _pack(conv, part: int, at: int, cell: Cell, head: str, tail: str, illegal: int) -> tuple:
    return conv, part, at, [-1 if x is None else x[0] for x in cell], [None if x is None else x[1] for x in cell], head, tail, illegal


def _illegal(initials) -> int:
    return sum(a + b not in GOOD_PAIRS for a, b in zip(initials, initials[1:]))


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One part for each block of rows."""
    for batch in batches:
        out = []
        for conv, part, at, initials, marks in zip(batch["conv_id"], batch["part"], batch["at"], batch["initials"], batch["marks"]):
            rows = tuple(zip(initials, (int(m) for m in marks)))
            cell = _parse(rows) if len(rows) <= 16 else fold([row_cell(i, f) for i, f in rows])
            out.append(_pack(conv, part, at, cell, rows[0][0], rows[-1][0], _illegal([i for i, _ in rows])))
        yield pd.DataFrame(out, columns=["conv_id", "part", "at", "cost", "audit", "head", "tail", "illegal"])


def _join(frame: pd.DataFrame) -> pd.DataFrame:
    """The parts of one group, in order, as one."""
    frame = frame.sort_values("at", kind="stable")
    cells = [tuple(None if c < 0 else (int(c), a) for c, a in zip(costs, audits)) for costs, audits in zip(frame["cost"], frame["audit"])]
    heads, tails = list(frame["head"]), list(frame["tail"])
    illegal = int(frame["illegal"].sum()) + sum(a + b not in GOOD_PAIRS for a, b in zip(tails, heads[1:]))
    row = _pack(frame["conv_id"].iloc[0], int(frame["part"].iloc[0]), int(frame["at"].iloc[0]), fold(cells), heads[0], tails[-1], illegal)
    return pd.DataFrame([row], columns=["conv_id", "part", "at", "cost", "audit", "head", "tail", "illegal"])


def parse(marked: DataFrame, block: int = 256, fan: int = 64) -> DataFrame:
    """conv_id, cost, audit, illegal of every conversation of ``marked`` (conv_id, place, initial, fault).

    ``block``: rows of a first span; ``fan``: partitions whose parts are combined in one task.
    """
    rows = marked.select(F.col("conv_id").cast("string"), "place", "initial", "fault", F.floor(F.col("place") / SPAN).alias("part"),
                         F.floor(F.pmod("place", F.lit(SPAN)) / block).alias("slot"))
    spans = rows.groupBy("conv_id", "part", "slot").agg(F.min("place").alias("at"), F.array_sort(F.collect_list(F.struct("place", "initial", "fault"))).alias("rows"))
    spans = spans.select("conv_id", "part", "at", F.col("rows.initial").alias("initials"), F.col("rows.fault").alias("marks")).mapInPandas(_spans, PART)
    done = None
    width = 1  # partitions that one group holds
    while True:
        spans = materialize(spans, "spans")
        sizes = spans.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
        spread = spans.join(sizes.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
        ready = spread.where("n = 1").drop("n")
        done = ready if done is None else done.unionByName(ready)
        spread = spread.where("n > 1").drop("n")
        if spread.isEmpty():
            break
        spans = spread.groupBy("conv_id", F.floor(F.col("part") / width).alias("_g")).applyInPandas(_join, PART)
        width *= fan

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [best(tuple(None if c < 0 else (int(c), a) for c, a in zip(costs, audits))) for costs, audits in zip(batch["cost"], batch["audit"])]
            yield pd.DataFrame({"conv_id": batch["conv_id"], "cost": [c for c, _ in found], "audit": [a for _, a in found], "illegal": batch["illegal"]})

    return done.mapInPandas(finish, "conv_id string, cost long, audit string, illegal long")


# --------------------------------------------------------------------- repaired conversations

def apply(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired rows: ``rows`` are read once, in order."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        state = STEP[state, role[:1]]
        yield role, text


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by conversation and place, each conversation led by its audit."""
    def rows():
        for batch in batches:
            yield from zip(batch["conv_id"], batch["place"], batch["role"], batch["text"])

    stream = rows()
    row = next(stream, None)
    while row is not None:
        conv, _place, _role, audit = row
        row = None
        digest, first = hashlib.sha256(), True

        def own():
            nonlocal row
            for row in stream:
                if row[1] < 0:  # the next conversation's audit
                    return
                yield row[2], row[3]
            row = None

        mine = own()
        for role, text in apply(audit, mine):
            digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            first = False
        for _ in mine:  # past the last row
            pass
        yield pd.DataFrame({"conv_id": [conv], "repaired_sha256": [digest.hexdigest()]})


def _batched(frames: Iterator[pd.DataFrame], rows: int = 2000) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if len(held) >= rows:
            yield pd.concat(held)
            held = []
    if held:
        yield pd.concat(held)


def hashes(placed: DataFrame, parsed: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256. A conversation's rows pass one task as a stream, since its hash has no parts."""
    rows = placed.select(F.col("conv_id").cast("string"), "place", "role", "text").unionByName(
        parsed.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text")))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInPandas(
        lambda it: _batched(_hashes(it)), "conv_id string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the repaired turns themselves, for any table of conversations (no damage is planted)."""
    placed = ordered(rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text")))
    parsed = parse(faults(placed))
    kind = rows.schema["conv_id"].dataType

    def turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, audit, at, state, n = object(), "", 0, 0, 0
        for batch in batches:
            out = []

            def inserts() -> None:
                nonlocal at, state, n
                while at < len(audit) and audit[at] == "I":
                    role = "assistant" if state == 2 else "user"
                    state, at, n = STEP[state, role[0]], at + 1, n + 1
                    out.append((conv, n - 1, role, ""))

            for c, place, role, text in zip(batch["conv_id"], batch["place"], batch["role"], batch["text"]):
                if place < 0:
                    conv, audit, at, state, n = c, text, 0, 0, 0
                else:
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        role = role if edit == "K" else "assistant" if state == 2 else "user"
                        out.append((conv, n, role, text))
                        state, n = STEP[state, role[:1]], n + 1
                inserts()
            yield pd.DataFrame(out, columns=["conv_id", "place", "role", "text"])

    both = placed.select(F.col("conv_id").cast("string"), "place", "role", "text").unionByName(
        parsed.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text")))
    out = both.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInPandas(turns, "conv_id string, place long, role string, text string")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def report(rows: DataFrame) -> DataFrame:
    """Faults, least repair and hash of every damaged conversation of ``rows`` (conv_id, turn, role, text)."""
    kind = rows.schema["conv_id"].dataType
    placed = ordered(damage(rows))
    marked = materialize(faults(placed), "marked")
    counts = marked.groupBy(F.col("conv_id").cast("string").alias("c")).agg(
        *[F.sum((F.col("fault") == v).cast("long")).alias(n) for n, v in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))],
        F.min("turn").alias("low"), F.max("turn").alias("high"))
    turns = marked.where(F.col("turn").isNotNull()).select(F.col("conv_id").cast("string").alias("c2"), "turn").distinct().groupBy("c2").agg(F.count(F.lit(1)).alias("n"))
    parsed = materialize(parse(marked), "parsed")
    every = rows.select(F.col("conv_id").cast("string").alias("conv_id")).distinct()
    whole = (every.join(counts, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(turns, F.col("conv_id").eqNullSafe(F.col("c2")), "left")
             .join(parsed.withColumnRenamed("conv_id", "c3"), F.col("conv_id").eqNullSafe(F.col("c3")), "left")
             .join(hashes(placed, parsed).withColumnRenamed("conv_id", "c4"), F.col("conv_id").eqNullSafe(F.col("c4")), "left"))

    def long(c) -> Column:
        return F.coalesce(c, F.lit(0)).cast("long")

    return whole.select(
        F.col("conv_id").cast(kind).alias("conv_id"), long(F.col("high") - F.col("low") + 1 - F.col("n")).alias("gaps"),
        *[long(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
