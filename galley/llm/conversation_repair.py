"""Conversation structure repair over a suffix-shared automaton of signatures.

A conversation's signature has one letter per row: its role, whether it is cut short, or that it must go. Read from the end,
signatures that end alike share the nodes of one acyclic automaton: a node is a distinct rest of a signature. For each node and each
state of the role grammar, the least cost of finishing and the first letters of the best audit are worked out once, from the node
behind it; the rest of the best audit is that node's own. Signatures are dealt out by their reversed text, so that all that share
rests meet in one task, where the path to the last signature is the only part of the automaton that must be held; a signature that
very many conversations have is split by conversation.

Rows are dealt out by conversation and turn, so that one long conversation is cut into pieces over many tasks. Pieces carry letters,
counts and texts; only the letters of a whole conversation ever come together, and its text is hashed as a stream.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.common import pick, stored

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
KEEP, DELETE, INSERT, REROLE = "K", "D", "I", "R"
COST = {KEEP: 0, DELETE: 4, INSERT: 3, REROLE: 3}
CUT_SHORT = 3
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a. Where each role leads; a missing entry is not allowed.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that an inserted or re-labelled row must have in each state.
WANTED = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
ACCEPTING = (0, 3)
#: Adjacent role initials that are in order.
LEGAL = {"su", "ua", "au"}
MUST_GO = "x"


class Solver:
    """Nodes of the automaton by what they decide: costs to go above the least of them, and the choice in each grammar state.

    Nodes whose rests differ but whose costs do not are one entry, so the table stays small however many signatures there are.
    """

    def __init__(self):
        self.entries: list[tuple[tuple[int, ...], tuple[tuple[str, int], ...]]] = []
        self.number: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        values = [(0, "", g) if g in ACCEPTING else None for g in range(4)]
        self.end = self._enter(self._insert(values))

    def _insert(self, base: list[tuple[int, str, int] | None]) -> list[tuple[int, str, int]]:
        """The best of going on at once and of inserting rows first; equal costs go to the smaller first letter.

        Two states that lead to each other need one insertion each, so no more than two follow one another.
        """

        def better(own, behind):
            if behind is None:
                return own
            other = (behind[0] + COST[INSERT], INSERT + behind[1], behind[2])
            return other if own is None or other[:2] < own[:2] else own

        out = list(base)
        out[2], out[3] = better(base[2], base[3]), better(base[3], base[2])
        out[0], out[1] = better(base[0], out[2]), better(base[1], out[2])
        return out

    def _enter(self, values: list[tuple[int, str, int]]) -> tuple[int, int]:
        """(entry, least cost) of a node."""
        least = min(v[0] for v in values)
        entry = tuple(v[0] - least for v in values), tuple(v[1:] for v in values)
        if entry not in self.number:
            self.number[entry] = len(self.entries)
            self.entries.append(entry)
        return self.number[entry], least

    def before(self, node: int, letter: str) -> tuple[int, int]:
        """(entry, cost added) of the node for a signature's rest that begins with ``letter`` and goes on at ``node``."""
        key = node, letter
        if key not in self.steps:
            costs, role, late = self.entries[node][0], letter.lower(), CUT_SHORT if letter.isupper() else 0
            base = []
            for g in range(4):
                ways = [(COST[DELETE] + costs[g], DELETE, g)]
                if letter != MUST_GO:
                    if role in NEXT[g]:
                        ways.append((COST[KEEP] + late + costs[NEXT[g][role]], KEEP, NEXT[g][role]))
                    behind = NEXT[g][WANTED[g]]
                    ways.append((COST[REROLE] + late + costs[behind], REROLE, behind))
                # No two ways have the same letter, and equal costs go to the smaller one.
                base.append(min(ways))
            self.steps[key] = self._enter(self._insert(base))
        return self.steps[key]

    def cost(self, node: int, base: int, state: int = 0) -> int:
        return base + self.entries[node][0][state]


class Paths:
    """Walks the automaton over signatures in the order of their reversed text, holding the path to the last one."""

    def __init__(self):
        self.solver = Solver()
        self.last = ""
        first, least = self.solver.end
        self.nodes, self.costs = array("l", [first]), array("q", [least])
        self.made = 0  # nodes worked out

    def to(self, reverse: str) -> tuple[int, list[str]]:
        """(cost, letters of the audit by row with the insertions before it, the last entry being insertions at the end)."""
        shared = _common(self.last, reverse)
        del self.nodes[shared + 1 :], self.costs[shared + 1 :]
        for letter in reverse[shared:]:
            node, more = self.solver.before(self.nodes[-1], letter)
            self.nodes.append(node)
            self.costs.append(self.costs[-1] + more)
            self.made += 1
        self.last = reverse
        audit, state, entries = [], 0, self.solver.entries
        for node in reversed(self.nodes):
            letters, state = entries[node][1][state]
            audit.append(letters)
        return self.solver.cost(self.nodes[-1], self.costs[-1]), audit


def _common(a: str, b: str) -> int:
    """Length of the common beginning of two texts."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def advance(state: int, letters: str, roles: Iterator[str]) -> int:
    """The grammar state after some letters of an audit; ``roles`` gives the roles of the rows."""
    for x in letters:
        if x == INSERT:
            state = NEXT[state][WANTED[state]]
        else:
            role = next(roles)
            if x == KEEP:
                state = NEXT[state][role]
            elif x == REROLE:
                state = NEXT[state][WANTED[state]]
    return state


def repaired(state: int, letters: str, rows: Iterator[tuple[str, str]]) -> list[str]:
    """The ``role:text`` lines that letters of an audit leave of rows of (role, text)."""
    out = []
    for x in letters:
        if x == INSERT:
            out.append(NAMES[WANTED[state]] + ":")
            state = NEXT[state][WANTED[state]]
            continue
        role, text = next(rows)
        if x == KEEP:
            out.append(f"{role}:{text}")
            state = NEXT[state][role[:1]]
        elif x == REROLE:
            out.append(f"{NAMES[WANTED[state]]}:{text}")
            state = NEXT[state][WANTED[state]]
    return out


def letter_of(role: str, text: str) -> str:
    """The signature's letter of a row that stays possible: the role's initial, upper case where the text is cut short."""
    x = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return x if text.rstrip(SPACE)[-1:] in tuple(ENDS) else x.upper()


PIECE = pa.schema(
    [(n, pa.string()) for n in ("k",)]
    + [(n, pa.int64()) for n in ("piece", "turns", "first_turn", "last_turn", "illegal", "blank", "duplicate", "truncated")]
    + [(n, pa.string()) for n in ("signature", "initial", "final")]
    + [("seen", pa.list_(pa.binary())), ("at", pa.list_(pa.int32())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
)
PIECE_DDL = """k string, piece bigint, turns bigint, first_turn bigint, last_turn bigint, illegal bigint, blank bigint, duplicate bigint, truncated bigint,
    signature string, initial string, final string, seen array<binary>, at array<int>, roles array<string>, texts array<string>"""


class Piece:
    """Rows of one conversation in order, up to the bounds of a piece: rows, and characters of its texts."""

    def __init__(self, k: str, number: int, bounds: tuple[int, int]):
        self.bounds = bounds
        self.row = {n: 0 for n in ("turns", "illegal", "blank", "duplicate", "truncated")} | {"k": k, "piece": number, "first_turn": None, "last_turn": None, "initial": None, "final": None}
        self.letters, self.roles, self.texts, self.known, self.size = [], [], [], {}, 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        row, at, initial = self.row, len(self.letters), role[:1]
        if turn is not None and turn != row["last_turn"]:
            row["turns"] += 1
            row["last_turn"] = turn
            if row["first_turn"] is None:
                row["first_turn"] = turn
        if at == 0:
            row["initial"] = initial
        elif row["final"] + initial not in LEGAL:
            row["illegal"] += 1
        row["final"] = initial
        if not text.strip(SPACE):
            row["blank"] += 1
            letter = MUST_GO
        elif (role, text) in self.known:
            row["duplicate"] += 1
            letter = MUST_GO
        else:
            self.known[role, text] = at
            letter = letter_of(role, text)
            row["truncated"] += letter.isupper()
        self.letters.append(letter)
        # What must go is never written again.
        self.roles.append(None if letter == MUST_GO else role)
        self.texts.append(None if letter == MUST_GO else text)
        self.size += len(text)

    def full(self) -> bool:
        return len(self.letters) >= self.bounds[0] or self.size >= self.bounds[1]

    def done(self, alone: bool) -> dict:
        """As one row; a piece that may not be its conversation's only one names its different rows by digest."""
        known = {} if alone else self.known
        seen = [hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest() for r, t in known]
        return self.row | {"signature": "".join(self.letters), "seen": seen, "at": list(known.values()), "roles": self.roles, "texts": self.texts}


def _cutter(bounds: tuple[int, int]):
    """Pieces of rows (k, turn, role, text, copies) in order; numbered in the order of the whole table."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        number = TaskContext.get().partitionId() << 40
        # The first conversation of a task may have begun in the task before, one that is cut goes on, the last may go on elsewhere.
        piece, open_ = None, True
        for batch in batches:
            for k, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if piece is None or piece.row["k"] != k:
                    if piece is not None:
                        yield piece.done(alone=not open_)
                        open_ = False
                    piece = Piece(k, number, bounds)
                    number += 1
                for _ in range(copies):
                    if piece.full():
                        yield piece.done(alone=False)
                        piece, open_ = Piece(k, number, bounds), True
                        number += 1
                    piece.add(turn, role, text)
        if piece is not None:
            yield piece.done(alone=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in pieces(batches):
            held.append(row)
            size += sum(len(t) for t in row["texts"] if t)
            if len(held) >= 500 or size >= bounds[1]:
                yield pa.RecordBatch.from_pylist(held, schema=PIECE)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=PIECE)

    return run


def _across(pieces: DataFrame) -> DataFrame:
    """``piece, late``: places of rows that an earlier piece of the conversation has already."""
    rows = pieces.where(F.size("seen") > 0).select("k", "piece", F.explode(F.arrays_zip("seen", "at")).alias("x")).select("k", "piece", F.col("x.seen").alias("seen"), F.col("x.at").alias("at"))
    first = rows.groupBy("k", "seen").agg(F.min("piece").alias("first"))
    return rows.join(first, ["k", "seen"]).where(F.col("piece") > F.col("first")).groupBy("piece").agg(F.sort_array(F.collect_list("at")).alias("late"))


def _struck(pieces: DataFrame) -> DataFrame:
    """The pieces' letters and counts, with the rows struck out that an earlier piece has."""
    slim = pieces.drop("seen", "at", "roles", "texts").join(_across(pieces), "piece", "left")
    late = F.coalesce("late", F.array().cast("array<int>"))
    # Letters between the places that are struck: one piece of text per place.
    begins, ends = F.concat(F.array(F.lit(0)), F.transform(late, lambda x: x + 1)), F.concat(late, F.array(F.length("signature")))
    written = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(F.col("signature"), a + 1, b - a)), MUST_GO)
    gone = F.aggregate(late, F.lit(0).cast("long"), lambda n, i: n + (F.ascii(F.substring(F.col("signature"), i + 1, F.lit(1))) < 97).cast("long"))
    return slim.withColumns(
        {
            "signature": F.when(F.size(late) > 0, written).otherwise(F.col("signature")),
            "duplicate": F.col("duplicate") + F.size(late),
            "truncated": F.col("truncated") - gone,
        }
    ).drop("late")


def _whole(pieces: DataFrame) -> DataFrame:
    """One row per conversation: its signature, counts, and its pieces with their lengths in order."""
    fields = ("piece", "signature", "turns", "first_turn", "last_turn", "illegal", "blank", "duplicate", "truncated", "initial", "final")
    every = pieces.groupBy("k").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("p"))
    held = F.filter("p", lambda x: F.length(x["signature"]) > 0)
    every = every.withColumn("held", held)
    dated = F.filter("held", lambda x: x["first_turn"].isNotNull())
    every = every.withColumn("dated", dated)
    pairs = lambda c, test: F.size(F.filter(F.zip_with(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), test), lambda x: x))
    total = lambda c, name: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x[name])
    order = lambda a, b: ~F.concat(a["final"], b["initial"]).isin(*sorted(LEGAL))
    same = lambda a, b: a["last_turn"] == b["first_turn"]
    wide = lambda c: c.cast("decimal(38,0)")
    span = wide(F.element_at("dated", -1)["last_turn"]) - wide(F.element_at("dated", 1)["first_turn"]) + 1 - wide(total("dated", "turns")) + pairs("dated", same)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    return every.select(
        "k",
        F.array_join(F.transform("held", lambda x: x["signature"]), "").alias("signature"),
        F.transform("p", lambda x: F.struct(x["piece"].alias("piece"), F.length(x["signature"]).alias("rows"))).alias("pieces"),
        F.when(F.size("dated") > 0, F.least(span, most).cast("long")).otherwise(F.lit(0).cast("long")).alias("gaps"),
        *[total("held", n).alias(n) for n in ("blank", "duplicate", "truncated")],
        (total("held", "illegal") + pairs("held", order)).alias("illegal"),
    )


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal")
AUDIT = pa.schema([("k", pa.string()), ("piece", pa.int64()), ("n_pieces", pa.int64()), ("state", pa.int32()), ("letters", pa.string())] + [(n, pa.int64()) for n in (*NUMBERS, "cost")] + [("audit", pa.string())])
AUDIT_DDL = "k string, piece bigint, n_pieces bigint, state int, letters string, " + ", ".join(f"{n} bigint" for n in (*NUMBERS, "cost")) + ", audit string"


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits of conversations in the order of their reversed signatures, dealt out to their pieces."""
    paths, last, cost, audit = Paths(), None, 0, []
    for batch in batches:
        out = {f.name: [] for f in AUDIT}
        for k, reverse, pieces, *numbers in zip(*(c.to_pylist() for c in batch.columns)):
            if reverse != last:
                last, (cost, audit) = reverse, paths.to(reverse)
            at, state, roles = 0, 0, iter(reverse[::-1].lower())
            for i, p in enumerate(pieces):
                end = at + p["rows"]
                letters = "".join(audit[at : end + (i == len(pieces) - 1)])
                whole = [*numbers, cost, "".join(audit)] if i == 0 else [None] * (len(numbers) + 2)
                for name, value in zip(out, (k, p["piece"], len(pieces), state, letters, *whole)):
                    out[name].append(value)
                state, at = advance(state, letters, roles), end
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in AUDIT], schema=AUDIT)


WRITTEN = pa.schema([*AUDIT, ("lines", pa.int64()), ("written", pa.string())])
WRITTEN_DDL = AUDIT_DDL + ", lines bigint, written string"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each piece's audit leaves of its rows; roles and texts are the last two columns."""
    for whole in batches:
        for lo in range(0, max(1, whole.num_rows), 500):
            batch = whole.slice(lo, 500)
            lines = [
                repaired(state, letters, zip(roles, texts))
                for state, letters, roles, texts in zip(*(batch.column(n).to_pylist() for n in ("state", "letters", "roles", "texts")))
            ]
            cols = [*batch.columns[: len(AUDIT)], pa.array([len(x) for x in lines], pa.int64()), pa.array(["\n".join(x) for x in lines], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, schema=WRITTEN)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its written pieces in order, hashed as they come."""
    names = [n for n in AUDIT.names if n not in ("piece", "n_pieces", "state", "letters")]
    schema = pa.schema([*(AUDIT.field(n) for n in names), ("repaired_sha256", pa.string())])
    row, state, begun = None, None, False
    for batch in batches:
        done = []
        for part in batch.to_pylist():
            if row is None or row["k"] != part["k"]:
                if row is not None:
                    done.append(row | {"repaired_sha256": state.hexdigest()})
                row, state, begun = {n: part[n] for n in names}, hashlib.sha256(), False
            if part["lines"]:
                state.update((("\n" if begun else "") + part["written"]).encode())
                begun = True
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    if row is not None:
        yield pa.RecordBatch.from_pylist([row | {"repaired_sha256": state.hexdigest()}], schema=schema)


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, copies``: rows damaged by the crc32 of ``conv:turn`` modulo 20.

    0 drops a row (``copies`` 0), 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it (``copies`` 2), 4 makes it the user's.
    A null of any column counts as one space, but a null turn stays null.
    """
    rows = pick(df, conv, turn, role, text)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    return rows.select(
        conv,
        turn,
        F.when(kind == 4, F.lit("user")).otherwise(shown(role)).alias(role),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(shown(text), "[.!?]", "")).otherwise(shown(text)).alias(text),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, piece_rows: int = 50_000, piece_chars: int = 2 << 20) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation.

    Rows come in the order of turn (nulls first), role and text; each stands as often as column ``copies`` says (once without it; a conversation whose
    rows all stand 0 times has no faults and an empty audit). ``audit`` is the cheapest list of edits (K, R, D, I) after which the roles'
    initials read (s?(ua)+)?, ASCII-least among equals: blank and repeated rows must go. ``gaps`` are turns missing between the first
    and the last. The hash is of the repaired ``role:text`` lines.

    Null role or text is one space, a null conversation is one of its own, repeated rows are faults like any, an empty table gives no
    rows, other columns are ignored. A conversation of any length is cut into pieces; its letters and its audit, one character a row,
    are all of it that one task holds.
    """
    rows = pick(df, conv, turn, role, text, *([copies] if copies else []))
    kind = dict(rows.dtypes)[conv]
    key = F.when(F.col(conv).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(conv).cast("string")))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    slim = rows.select(key.alias("k"), F.col(turn).cast("long").alias("turn"), shown(role).alias("role"), shown(text).alias("text"), (F.col(copies) if copies else F.lit(1)).cast("int").alias("copies"))
    order = ["k", F.col("turn").asc_nulls_first(), "role", "text"]
    # Rows that are equal in everything may still be dealt to different tasks.
    numbered = slim.withColumn("place", F.monotonically_increasing_id())
    placed = numbered.repartitionByRange(*order, "place").sortWithinPartitions(*order).drop("place")
    pieces = stored(placed.mapInArrow(_cutter((piece_rows, piece_chars)), PIECE_DDL))
    whole = _whole(_struck(pieces)).withColumn("reverse", F.reverse("signature"))
    dealt = whole.repartitionByRange("reverse", "k").sortWithinPartitions("reverse", "k")
    audits = stored(dealt.select("k", "reverse", "pieces", *NUMBERS).mapInArrow(_audits, AUDIT_DDL))
    texts = pieces.select("piece", "roles", "texts")
    written = lambda some: some.join(texts, "piece").select(*AUDIT.names, "roles", "texts").mapInArrow(_write, WRITTEN_DDL)
    names = ["k", *NUMBERS, "cost", "audit"]
    one = written(audits.where("n_pieces = 1")).select(*names, F.sha2("written", 256).alias("repaired_sha256"))
    more = written(audits.where("n_pieces > 1")).repartition("k").sortWithinPartitions("k", "piece")
    out = one.unionByName(more.mapInArrow(_hash, ", ".join(f"{n} {'string' if n in ('k', 'audit') else 'bigint'}" for n in names) + ", repaired_sha256 string"))
    value = F.when(F.col("k") != "n", F.expr("substring(k, 2)")).cast(kind)
    return out.select(value.alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
