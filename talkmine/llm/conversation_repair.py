"""Cheapest repair of the structure of conversations: a run-length dynamic program.

Roles must read ``(s?(ua)+)?`` by their initials. Each row may be kept, deleted or given another
role, and rows may be inserted; a row's effect on the cost of being in each of the pattern's four
states is a 4 x 4 matrix in min-plus arithmetic. Equal consecutive rows (in role and fault) are one
run, which is advanced at once by binary powers of its matrix, made once and kept.

Rows are sorted into ranges by conversation and turn, one range a task, so a conversation of any
length is many tasks. Only the first and the last conversation of a range may go on in another
one; for these few (two a range, whatever the data) the matrices of whole stretches are multiplied.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmine.llm.text import tidy
from talkmine.session import cut_lineage

#: states of the role pattern: nothing yet, after s, after u, after a
START, S, U, A = range(4)
STATES = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: the only role that may be inserted or given in each state, and the state after it
_NEXT = (U, U, A, U)
_ROLE = {U: "user", A: "assistant"}
_KEPT = {"s": (S, None, None, None), "u": (U, U, None, U), "a": (None, None, A, None)}
_NEVER = 1 << 60
#: a row that must go, whatever its role
GO = ("", True)

#: rows that a range holds about, and bytes of text that are handed on at once
RANGE_ROWS, CHUNK = 50_000, 4 << 20
#: rows of a run whose choices are unrolled at once
STRETCH = 4096

_BLANKS = " \t\n\x0b\x0c\r"

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


# --- min-plus arithmetic -------------------------------------------------------------------

def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(_NEVER, *[a[i][k] + b[k][j] for k in STATES]) for j in STATES) for i in STATES)


def onto(a: Matrix, v: Vector) -> Vector:
    v0, v1, v2, v3 = v
    return tuple([min(r[0] + v0, r[1] + v1, r[2] + v2, r[3] + v3) for r in a])


ONE: Matrix = tuple(tuple(0 if i == j else _NEVER for j in STATES) for i in STATES)
#: any number of rows inserted; more than two never pay
_INSERTED = times(*[tuple(tuple(0 if i == j else INSERT if j == _NEXT[i] else _NEVER for j in STATES) for i in STATES)] * 2)
#: cost to the end of a conversation after its last row
END = onto(_INSERTED, (0, _NEVER, _NEVER, 0))


def choices(symbol: tuple[str, bool], state: int) -> list[tuple[str, int, int]]:
    """(letter, state after, cost) of what may be done with a row, in order of letters.

    A symbol is (initial, whether it is truncated), or ``GO``.
    """
    found = [("D", state, DELETE)]
    if symbol != GO:
        initial, more = symbol[0], TRUNCATED if symbol[1] else 0
        kept = _KEPT[initial][state] if initial in _KEPT else None
        if kept is not None:
            found.append(("K", kept, KEEP + more))
        found.append(("R", _NEXT[state], REROLE + more))
    return found


@lru_cache(maxsize=None)
def power(symbol: tuple[str, bool], exponent: int) -> Matrix:
    """Matrix of ``2 ** exponent`` rows of one symbol, with what is inserted before them."""
    if exponent:
        half = power(symbol, exponent - 1)
        return times(half, half)
    step = [[_NEVER] * 4 for _ in STATES]
    for state in STATES:
        for _, after, cost in choices(symbol, state):
            step[state][after] = min(step[state][after], cost)
    return times(_INSERTED, tuple(tuple(r) for r in step))


def before_run(symbol: tuple[str, bool], length: int, rest: Vector) -> Vector:
    """Cost to the end before a run, from that after it."""
    exponent = 0
    while length:
        if length & 1:
            rest = onto(power(symbol, exponent), rest)
        length >>= 1
        exponent += 1
    return rest


def run_matrix(runs: list[list]) -> Matrix:
    """Matrix of a whole stretch of runs."""
    whole = ONE
    for symbol, length in runs:
        exponent = 0
        while length:
            if length & 1:
                whole = times(whole, power(symbol, exponent))
            length >>= 1
            exponent += 1
    return whole


def unroll(runs: list[list], state: int, rest: Vector, last: bool) -> Iterator[tuple[str, int, int, bool]]:
    """(letter, how often, state after, whether a row had a choice) of the cheapest edits, the least
    letters among equals.

    ``rest`` is the cost to the end after the runs; ``last`` says that the conversation ends there,
    so rows may be inserted behind. From every state a letter leads to one state only, so
    taking the least letter that keeps to the cheapest cost gives the least audit.
    """
    ahead = [rest]
    for symbol, length in reversed(runs):
        ahead.append(before_run(symbol, length, ahead[-1]))
    ahead.pop()
    for symbol, length in runs:
        after_run = ahead.pop()
        if symbol == GO:
            # what is inserted beside deleted rows comes after them at the same cost
            yield "D", length, state, False
            continue
        while length:
            stretch = min(length, STRETCH)
            length -= stretch
            costs = [before_run(symbol, length, after_run)]
            for _ in range(stretch):
                costs.append(onto(power(symbol, 0), costs[-1]))
            now = costs.pop()
            while costs:
                after = costs.pop()
                while True:
                    options = choices(symbol, state)
                    options.insert(1, ("I", _NEXT[state], INSERT))
                    letter, to = next((name, to) for name, to, cost in options
                                      if cost + (now if name == "I" else after)[to] == now[state])
                    state = to
                    yield letter, 1, state, letter != "I"
                    if letter != "I":
                        break
                now = after
    while last and END[state]:
        state = _NEXT[state]
        yield "I", 1, state, False


# --- stretches of one conversation ---------------------------------------------------------

class Stretch:
    """Consecutive rows of one conversation: counts, runs, and the rows that may stay."""

    def __init__(self, conv) -> None:
        self.conv = conv
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.head = self.tail = None
        self.runs: list[list] = []
        self.rows: list[tuple[str, str]] = []

    def add(self, turn, role: str | None, copies: int, first: bool, fault: str, text: str | None) -> None:
        """Equal rows that follow each other; without a role it only says that the conversation is there."""
        if role is None:
            return
        if turn is not None:
            if turn != self.high:
                self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        if self.head is None:
            self.head = initial
        else:
            self.illegal += self.tail + initial not in ("su", "ua", "au")
        self.illegal += copies - 1
        self.tail = initial
        if fault == "blank":
            self.blank += copies
            self._run(GO, copies)
            return
        if first:
            self.truncated += fault == "truncated"
            self._run((initial if initial in _KEPT else "o", fault == "truncated"), 1)
            self.rows.append((role, text))
            copies -= 1
        if copies:
            self.duplicate += copies
            self._run(GO, copies)

    def _run(self, symbol, length: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += length
        else:
            self.runs.append([symbol, length])

    def before(self, rest: Vector) -> Vector:
        for symbol, length in reversed(self.runs):
            rest = before_run(symbol, length, rest)
        return rest

    def exits(self, rest: Vector) -> list[int]:
        """State after the stretch for each one before it."""
        out = []
        for state in STATES:
            for _, _, state, _ in unroll(self.runs, state, rest, False):
                pass
            out.append(state)
        return out

    def edits(self, state: int, rest: Vector, last: bool) -> Iterator[tuple[str, str | None]]:
        """(letters, repaired row or None) of each edit."""
        rows = iter(self.rows)
        for letter, often, after, chosen in unroll(self.runs, state, rest, last):
            role, text = next(rows) if chosen else (None, "")
            if letter == "D":
                yield "D" * often, None
            else:
                yield letter, f"{role if letter == 'K' else _ROLE[after]}:{text}"


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Stretch]]:
    """(range, stretch) of sorted rows, one stretch at a time."""
    now, place = None, None
    for batch in batches:
        texts = batch.column("text").to_pylist() if "text" in batch.schema.names else [None] * batch.num_rows
        for piece, conv, turn, role, copies, first, fault, text in zip(
                *[batch.column(c).to_pylist() for c in ("piece", "conv_id", "turn", "role", "copies", "first", "fault")],
                texts):
            if now is None or now.conv != conv:
                if now is not None:
                    yield place, now
                now, place = Stretch(conv), piece
            now.add(turn, role, copies, first, fault, text)
    if now is not None:
        yield place, now


# --- the table ------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies after the damage that ``crc32(conv_id:turn) % 20`` says.

    Nulls count as one space in that key, in roles and in texts; turns keep them. A dropped row
    leaves one without role and text and of no copies, so that its conversation is still known.
    """
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    return conversations.select(
        "conv_id", F.when(kind != 0, F.col("turn")).alias("turn"),
        F.when(kind == 4, "user").when(kind != 0, filled("role")).alias("role"),
        F.when(kind != 0, text).alias("text"), F.when(kind == 3, 2).when(kind == 0, 0).otherwise(1).alias("copies"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, for repair of real conversations; nulls count as one space."""
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"))


def _sorted_ranges(rows: DataFrame, ranges: int) -> DataFrame:
    """Distinct rows in order, in ``ranges`` partitions, with copies, first and fault.

    Rows equal in all columns cross the network as one, and the first of equal texts in a
    conversation is found by an aggregation of digests, so no repeated row or text makes a task large.
    """
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = rows.withColumn("digest", F.unhex(F.sha2(said, 256)))
    firsts = rows.groupBy("conv_id", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull(), F.col("turn").alias("turn"))).alias("t"))
    none = F.lit(None).cast("string")
    both = rows.select("conv_id", "turn", "digest", "role", "text", "copies", F.lit(0).alias("first")).unionByName(
        firsts.select("conv_id", F.col("t.turn").alias("turn"), "digest", none.alias("role"), none.alias("text"),
                      F.lit(0).alias("copies"), F.lit(1).alias("first")))
    same = both.groupBy("conv_id", "turn", "digest").agg(
        F.max("role").alias("role"), F.max("text").alias("text"), F.sum("copies").alias("copies"), (F.max("first") == 1).alias("first"))
    tail = F.rtrim(F.col("text"), F.lit(_BLANKS))
    fault = F.when(tail == "", "blank").when(~F.right(tail, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    order = ["conv_id", "turn", "role", "text"]
    return same.drop("digest").withColumn("fault", fault).repartitionByRange(ranges, "conv_id", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions(
        *order).withColumn("piece", F.spark_partition_id())


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices of the first and the last stretch of a range."""
    first = last = None
    for piece, stretch in stretches(batches):
        if first is None:
            first = stretch
        last = stretch
    if first is not None:
        both = [first] if first is last else [first, last]
        yield pa.RecordBatch.from_arrays([
            pa.array([piece] * len(both), pa.int32()), pa.array(range(len(both)), pa.int32()), pa.array([s.conv for s in both]),
            pa.array([[x for row in run_matrix(s.runs) for x in row] for s in both], pa.list_(pa.int64()))],
            names=["piece", "place", "conv_id", "matrix"])


def _exits(rests: dict):
    """For each stretch that is cut, the state after it for each one before it."""

    def compute(batches):
        for piece, stretch in stretches(batches):
            if (piece, stretch.conv) in rests:
                yield pa.RecordBatch.from_arrays([
                    pa.array([piece], pa.int32()), pa.array([stretch.conv]),
                    pa.array([stretch.exits(rests[piece, stretch.conv])], pa.list_(pa.int32()))],
                    names=["piece", "conv_id", "exits"])

    return compute


def _cut(ranges: DataFrame, conv: str) -> dict:
    """(range, conversation) -> (cost to the end after it, state before it, whether it is the last,
    cost) of conversations in more than one range; the cost stands at the first of them.

    A range has at most two such stretches, each with a matrix of 16 numbers.
    """
    narrow = ranges.drop("text")
    ends = narrow.mapInArrow(_ends, f"piece int, place int, conv_id {conv}, matrix array<long>").collect()
    pieces: dict = {}
    for row in sorted(ends, key=lambda r: (r.piece, r.place)):
        pieces.setdefault(row.conv_id, []).append((row.piece, tuple(zip(*[iter(row.matrix)] * 4))))
    rests, costs = {}, {}
    for conv_id, parts in pieces.items():
        if len(parts) > 1:
            rest = END
            for piece, matrix in reversed(parts):
                rests[piece, conv_id] = rest
                rest = onto(matrix, rest)
            costs[parts[0][0], conv_id] = rest[START]
    if not rests:
        return {}
    exits = {(r.piece, r.conv_id): r.exits for r in narrow.mapInArrow(
        tidy(_exits(rests)), f"piece int, conv_id {conv}, exits array<int>").collect()}
    out = {}
    for conv_id, parts in pieces.items():
        if len(parts) > 1:
            state = START
            for piece, _ in parts:
                key = piece, conv_id
                out[key] = rests[key], state, piece == parts[-1][0], costs.get(key, 0)
                state = exits[key][state]
    return out


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def _repair(cut: dict, kind: pa.DataType):
    """Whole conversations repaired; stretches of cut ones in chunks, to be joined in order."""
    names = ["conv_id", "piece", "chunk", "turns", "low", "high", "head", "tail", *_COUNTS, "audit", "repaired"]
    types = [kind, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(),
             *[pa.int64()] * len(_COUNTS), pa.string(), pa.binary()]

    def compute(batches):
        rows, held = [], 0
        for piece, stretch in stretches(batches):
            whole = (piece, stretch.conv) not in cut
            rest, state, last, cost = cut.get((piece, stretch.conv)) or (END, START, True, stretch.before(END)[START])
            digest, begun = hashlib.sha256(), False
            letters, lines, size, chunk = [], [], 0, 0
            head = (stretch.turns, stretch.low, stretch.high, stretch.head, stretch.tail,
                    stretch.blank, stretch.duplicate, stretch.truncated, stretch.illegal, cost)
            for letter, line in stretch.edits(state, rest, last):
                letters.append(letter)
                if line is None:
                    continue
                # in a cut conversation every line brings its own line feed, and the first is taken off at the end
                data = line.encode() if whole and not begun else b"\n" + line.encode()
                begun = True
                if whole:
                    digest.update(data)
                    continue
                lines.append(data)
                size += len(data)
                if size >= CHUNK:
                    rows.append((stretch.conv, piece, chunk, *head, "".join(letters), b"".join(lines)))
                    held += size
                    letters, lines, size, chunk = [], [], 0, chunk + 1
                    head = (0, None, None, None, None, 0, 0, 0, 0, 0)
                    if held >= CHUNK:
                        yield _batch(rows, names, types)
                        rows, held = [], 0
            rows.append((stretch.conv, piece, -1 if whole else chunk, *head, "".join(letters),
                         digest.digest() if whole else b"".join(lines)))
            held += size + 512
            if held >= CHUNK:
                yield _batch(rows, names, types)
                rows, held = [], 0
        yield _batch(rows, names, types)

    return compute


def _batch(rows: list, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _join(kind: pa.DataType):
    """Chunks of conversations, in order, to one row each; a text is hashed as it comes."""
    names = ["conv_id", "turns", "low", "high", *_COUNTS, "audit", "repaired"]
    types = [kind, pa.int64(), pa.int64(), pa.int64(), *[pa.int64()] * len(_COUNTS), pa.string(), pa.binary()]

    def compute(batches):
        now = None
        done: list = []

        def close():
            done.append((now["conv"], now["turns"], now["low"], now["high"], *now["counts"],
                         "".join(now["letters"]), now["digest"].digest()))

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now["conv"] != row["conv_id"]:
                    if now is not None:
                        close()
                    now = {"conv": row["conv_id"], "turns": 0, "low": None, "high": None, "tail": None,
                           "counts": [0] * len(_COUNTS), "letters": [], "digest": hashlib.sha256(), "begun": False}
                now["counts"] = [a + row[c] for a, c in zip(now["counts"], _COUNTS)]
                if row["head"] is not None:
                    if now["tail"] is not None:
                        now["counts"][3] += now["tail"] + row["head"] not in ("su", "ua", "au")
                    now["tail"] = row["tail"]
                if row["low"] is not None:
                    now["turns"] += row["turns"] - (row["low"] == now["high"])
                    now["low"] = row["low"] if now["low"] is None else now["low"]
                    now["high"] = row["high"]
                now["letters"].append(row["audit"])
                if row["repaired"]:
                    now["digest"].update(row["repaired"] if now["begun"] else row["repaired"][1:])
                    now["begun"] = True
            if done:
                yield _batch(done, names, types)
                done.clear()
        if now is not None:
            close()
            yield _batch(done, names, types)

    return compute


def repair(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each
    conversation in ``rows`` (conv_id, turn, role, text and copies, as ``damaged`` gives).

    Rows are taken by turn, null first, then by role and text; copies of a row are adjacent. A null
    conv_id is a conversation of its own. A conversation none of whose rows is left has zeros, no
    audit and the hash of an empty text. Initials are case-sensitive, and a role that is empty or begins
    otherwise fits nowhere. An empty table gives no rows; other columns are ignored. Rows of any number
    are cut into ranges, but the audit of a conversation is one value, and its hash is made in one
    task, since SHA-256 can't be taken in parts: its texts pass there in chunks and aren't held.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    kind = pa.int64() if conv == "bigint" else pa.int32() if conv == "int" else pa.string()
    spark = rows.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // range_rows))
    ranges = cut_lineage(_sorted_ranges(rows, count))
    cut = _cut(ranges, conv)
    done = ranges.mapInArrow(tidy(_repair(cut, kind)), f"""conv_id {conv}, piece int, chunk int, turns long, low long,
        high long, head string, tail string, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired binary""")
    columns = ["conv_id", "turns", "low", "high", *_COUNTS, "audit", "repaired"]
    if cut:
        done = cut_lineage(done)
        parts = done.filter("chunk >= 0")
        joined = parts.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "chunk").mapInArrow(
            tidy(_join(kind)), f"""conv_id {conv}, turns long, low long, high long,
            {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired binary""")
        done = done.filter("chunk < 0").select(*columns).unionByName(joined)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return done.select("conv_id", gaps.alias("gaps"), *_COUNTS, "audit", F.lower(F.hex("repaired")).alias("repaired_sha256"))


ORACLE = r"""
with recursive table256 as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) t from range(256) r(i)),
keyed as (
  select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k from conversations),
hashed as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') txt,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(length(k)), lambda i: ascii(substr(k, (i + 1)::int, 1))::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 kind
  from keyed, table256),
after_damage as (
  select conv_id, turn, case when kind = 4 then 'user' else role end role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(txt, '[.!?]', '', 'g') else txt end txt,
    unnest(range(case when kind = 3 then 2 else 1 end)) cp
  from hashed where kind <> 0),
convs as (select conv_id, row_number() over (order by conv_id) g from (select distinct conv_id from conversations)),
placed as (
  select g, turn, role, txt, rtrim(txt, E' 	

') tail,
    row_number() over (partition by g order by turn nulls first, role, txt, cp) pos
  from after_damage d join convs c on d.conv_id is not distinct from c.conv_id),
faulted as (
  select *, substr(role, 1, 1) i, tail = '' blank,
    tail <> '' and row_number() over (partition by g, role, txt order by pos) > 1 dup,
    lag(substr(role, 1, 1)) over (partition by g order by pos) || substr(role, 1, 1) pair,
    max(pos) over (partition by g) n from placed),
marked as (
  select *, blank or dup gone, (not (blank or dup) and right(tail, 1) not in ('.', '!', '?'))::int cutoff from faulted),
back as (
  select g, n + 1 pos, 0 w0, 4 ws, 2 wu, 0 wa from (select distinct g, n from marked)
  union all
  select g, pos, least(y0, 2 + yu, 4 + ya), least(ys, 2 + yu, 4 + ya), least(yu, 2 + ya), least(ya, 2 + yu) from (
    select m.g, m.pos,
      least(3 + w0, case when not gone then least(cutoff + case i when 's' then ws when 'u' then wu else 999999999 end, cutoff + 2 + wu) end) y0,
      least(3 + ws, case when not gone then least(cutoff + case i when 'u' then wu else 999999999 end, cutoff + 2 + wu) end) ys,
      least(3 + wu, case when not gone then least(cutoff + case i when 'a' then wa else 999999999 end, cutoff + 2 + wa) end) yu,
      least(3 + wa, case when not gone then least(cutoff + case i when 'u' then wu else 999999999 end, cutoff + 2 + wu) end) ya
    from back b join marked m on m.g = b.g and m.pos = b.pos - 1)),
costs as (select g, pos, [w0, ws, wu, wa] w from back),
walk as (
  select c.g, 1::bigint pos, 1 q, '' audit, []::varchar[] lines from costs c where pos = 1
  union all
  select g, case when letter = 'I' then pos else pos + 1 end,
    case letter when 'D' then q when 'K' then kept else nxt end, audit || letter,
    case letter when 'D' then lines when 'K' then list_append(lines, role || ':' || txt)
      when 'R' then list_append(lines, case nxt when 3 then 'user:' else 'assistant:' end || txt)
      else list_append(lines, case nxt when 3 then 'user:' else 'assistant:' end) end
  from (
    select *, case when m_pos is not null and 3 + v[q] = w[q] then 'D' when 2 + w[nxt] = w[q] then 'I'
      when not gone and kept is not null and cutoff + v[kept] = w[q] then 'K' else 'R' end letter
    from (
      select p.*, c.w, d.w v, m.pos m_pos, m.role, m.txt, m.gone, m.cutoff,
        case q when 3 then 4 else 3 end nxt,
        case when i = 's' and q = 1 then 2 when i = 'u' and q <> 3 then 3 when i = 'a' and q = 3 then 4 end kept
      from walk p join costs c on c.g = p.g and c.pos = p.pos
      left join costs d on d.g = p.g and d.pos = p.pos + 1 left join marked m on m.g = p.g and m.pos = p.pos
      where m.pos is not null or c.w[p.q] > 0))),
ended as (
  select g, audit, array_to_string(lines, chr(10)) repaired from walk
  qualify row_number() over (partition by g order by length(audit) desc) = 1),
counted as (
  select g, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (blank) blank,
    count(*) filter (dup) duplicate, sum(cutoff) truncated, count(*) filter (pair not in ('su', 'ua', 'au')) illegal
  from marked group by g)
select conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate,
  coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, coalesce(w[1], 0)::bigint "cost",
  coalesce(audit, '') audit, sha256(coalesce(repaired, '')) repaired_sha256
from convs c left join counted n on n.g = c.g left join ended e on e.g = c.g left join costs t on t.g = c.g and t.pos = 1
"""
