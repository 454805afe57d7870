"""Conversation structure repair: the cheapest edits that make the turns of a
conversation alternate.

A conversation is legal if its role initials read ``(s?(ua)+)?``. Four states
tell what has been read: nothing, s, u, a. From the last turn backwards, the
cost of the best ending is a vector of four numbers, one per state. Vectors are
kept only at checkpoints, about every square root of the number of turns; the
walk forward works out the vectors of one stretch at a time again and writes,
of the edits that keep the cost tight, the ASCII-least letter: D(elete),
I(nsert), K(eep), R(erole).

Turns are sorted by conversation and turn over all tasks, in pieces of bounded
size, so a conversation may lie in many pieces. The vectors at the piece
borders are the outermost checkpoints: each piece gives a 4 x 4 table of costs
from its first state to its last, the tables are chained backwards; then each
piece walks from all four states, which are chained forwards; then all pieces
walk at once. What is chained is two rows a piece, not the turns.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadflow.functions.ordering import PIECE, sorted_pieces

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
START, SYSTEM, USER, ASSISTANT = range(4)  # states: what was read last
TURN = (USER, USER, ASSISTANT, USER)  # per state: the state after the next inserted or reroled turn
ROLE = ("user", "user", "assistant", "user")  # its role
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}  # (state, initial)
INITIALS = ("s", "u", "a")
OTHER, MUST_GO, CUT_SHORT = 3, 4, 8  # a turn's code: initial (0 to 3), plus flags
LEGAL = {(0, 1), (1, 2), (2, 1)}  # adjacent initials
END = (0.0, 4.0, 2.0, 0.0)  # costs after the last turn
NONE, BLANK, DUPLICATE, SHORT = range(4)  # first fault of a turn

PIECE_BYTES = 32_000_000
BODY_BYTES = 4_000_000  # repaired text of a split conversation that travels in one row
PREFIX = 64  # characters of a text that tell rows of one turn apart when pieces are cut


class Edits:
    """The steps of the cost recursion; each is worked out once per distinct
    (relative) vector and code, of which there are few."""

    def __init__(self):
        self.backward, self.forward = {}, {}

    @staticmethod
    def costs(code: int, after: tuple):
        """Per state the best cost of a turn and all after it: without and with
        turns inserted before it."""
        own = []
        for state in range(4):
            best = DELETE + after[state]
            if not code & MUST_GO:
                extra = TRUNCATED if code & CUT_SHORT else 0
                best = min(best, REROLE + extra + after[TURN[state]])
                kept = KEPT.get((state, code & 3))
                if kept is not None:
                    best = min(best, KEEP + extra + after[kept])
            own.append(best)
        user, assistant = min(own[USER], INSERT + own[ASSISTANT]), min(own[ASSISTANT], INSERT + own[USER])
        return own, (min(own[START], INSERT + user), min(own[SYSTEM], INSERT + user), user, assistant)

    def back(self, code: int, after: tuple):
        """(vector before the turn, less its least entry; that entry)."""
        found = self.backward.get((code, after))
        if found is None:
            _, here = self.costs(code, after)
            least = min(here)
            found = self.backward[code, after] = (tuple(x - least for x in here), least)
        return found

    def ahead(self, code: int, after: tuple, state: int):
        """(letters, next state) of the tight edits at a turn, ASCII-least."""
        found = self.forward.get((code, after, state))
        if found is None:
            key, letters = (code, after, state), ""
            _, here = self.costs(code, after)
            while True:
                if DELETE + after[state] == here[state]:
                    letters += "D"
                    break
                if INSERT + here[TURN[state]] == here[state]:
                    letters, state = letters + "I", TURN[state]
                    continue
                extra = TRUNCATED if code & CUT_SHORT else 0
                kept = KEPT.get((state, code & 3))
                if kept is not None and KEEP + extra + after[kept] == here[state]:
                    letters, state = letters + "K", kept
                else:
                    letters, state = letters + "R", TURN[state]
                break
            found = self.forward[key] = (letters, state)
        return found

    def table(self, codes: list) -> list:
        """Row-major 4 x 4 costs from the state before the codes to the state after."""
        columns = []
        for last in range(4):
            vector, total = tuple(0.0 if q == last else math.inf for q in range(4)), 0.0
            for code in reversed(codes):
                vector, least = self.back(code, vector)
                total += least
            columns.append([x + total for x in vector])
        return [columns[b][a] for a in range(4) for b in range(4)]

    def walk(self, codes: list, end: tuple, state: int):
        """Letters per turn and the state after the last, from ``state``, when
        ``end`` is the vector after the last turn."""
        n = len(codes)
        step = math.isqrt(n) + 1
        marks, vector = {}, end
        for i in range(n - 1, -1, -1):
            if (i + 1) % step == 0:
                marks[i + 1] = vector
            vector, _ = self.back(codes[i], vector)
        out = []
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            afters, vector = [], marks.get(hi, end)
            for i in range(hi - 1, lo - 1, -1):
                afters.append(vector)
                vector, _ = self.back(codes[i], vector)
            for i in range(lo, hi):
                letters, state = self.ahead(codes[i], afters[hi - 1 - i], state)
                out.append(letters)
        return out, state

    @staticmethod
    def ending(state: int):
        """Letters and roles inserted after the last turn."""
        roles = []
        while state not in (START, ASSISTANT):
            roles.append(ROLE[state])
            state = TURN[state]
        return "I" * len(roles), roles


def _codes(batch) -> tuple[np.ndarray, np.ndarray]:
    """(code per turn, row per turn) of some rows; a row stands for ``copies``
    equal turns, of which all but the first must go."""
    initial = np.full(batch.num_rows, OTHER, np.int64)
    own = np.asarray(batch.column("initial").to_pylist(), dtype=object)
    for k, name in enumerate(INITIALS):
        initial[own == name] = k
    fault = batch.column("fault").to_numpy().astype(np.int64)
    copies = batch.column("copies").to_numpy().astype(np.int64)
    code = initial + np.where((fault == BLANK) | (fault == DUPLICATE), MUST_GO, 0) + np.where(fault == SHORT, CUT_SHORT, 0)
    row = np.repeat(np.arange(len(code)), copies)
    again = np.r_[False, row[1:] == row[:-1]] if len(row) else np.zeros(0, bool)
    return np.where(again, initial[row] | MUST_GO, code[row]), row


def _stretches(table: pa.Table):
    """(conversation, first row, end row) of a sorted piece."""
    own = table.column("conv_id").combine_chunks()
    known = own.is_valid().to_numpy(zero_copy_only=False)
    value = own.fill_null(0).to_numpy()
    new = np.flatnonzero((value[1:] != value[:-1]) | (known[1:] != known[:-1])) + 1
    cuts = np.r_[0, new, len(value)]
    return [(int(value[a]) if known[a] else None, int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]


def _piece(batches):
    """One partition as a table (None if empty): a piece is bounded in bytes."""
    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches) if batches else None


EDGES = "conv_id long, piece int, side int, costs array<double>"


def _edges(batches):
    """Kernel: the first (side 0) and last (1) conversation of a piece, or the
    only one (2), with its table of costs."""
    table = _piece(batches)
    if table is None:
        return
    edits, rows = Edits(), []
    stretches = _stretches(table)
    for side, (conv, a, b) in ([(2, stretches[0])] if len(stretches) == 1 else [(0, stretches[0]), (1, stretches[-1])]):
        codes, _ = _codes(table.slice(a, b - a))
        rows.append((conv, table.column(PIECE)[0].as_py(), side, edits.table(codes.tolist())))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64())))],
                                     names=["conv_id", "piece", "side", "costs"])


def _chains(edges: list):
    """Runs of two and more rows of one conversation in adjacent pieces."""
    run = []
    for row in edges:
        if run and (row["conv_id"] != run[-1]["conv_id"] or row["piece"] == run[-1]["piece"]):
            if len(run) > 1:
                yield run
            run = []
        run.append(row)
    if len(run) > 1:
        yield run


def _ends(edges: list) -> dict:
    """Vector after the last turn of each part of a split conversation."""
    out = {}
    for run in _chains(edges):
        vector = END
        for row in reversed(run):
            out[row["piece"], row["side"]] = vector
            costs = np.array(row["costs"]).reshape(4, 4)
            here = (costs + np.array(vector)).min(axis=1)
            vector = tuple((here - here.min()).tolist())
    return out


def _arrivals(ends: dict):
    """Kernel: per part of a split conversation the states that its walk ends
    in from each of the four."""

    def run(batches):
        table = _piece(batches)
        if table is None:
            return
        own, edits, rows = ends.value, Edits(), []
        piece = table.column(PIECE)[0].as_py()
        stretches = _stretches(table)
        for side, k in ((0, 0), (1, -1), (2, 0)):
            if (piece, side) in own:
                conv, a, b = stretches[k]
                codes = _codes(table.slice(a, b - a))[0].tolist()
                rows.append((conv, piece, side, [edits.walk(codes, own[piece, side], q)[1] for q in range(4)]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())))],
                                             names=["conv_id", "piece", "side", "states"])

    return run


def _starts(edges: list, ends: dict, arrivals: dict) -> dict:
    """Per part of a split conversation: (state it starts in, vector after it,
    whether it is the last part)."""
    out = {}
    for run in _chains(edges):
        state = START
        for row in run:
            key = row["piece"], row["side"]
            out[key] = (state, ends[key], row is run[-1])
            state = arrivals[key][state]
    return out


COUNTS = ("turns", "blank", "duplicate", "truncated", "illegal", "cost")
PARTS = ("conv_id long, piece int, part int, least long, most long, " + ", ".join(f"{c} long" for c in COUNTS)
         + ", first int, last int, audit string, repaired binary, repaired_sha256 string")
AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, piece int, place long, edit string, role string, text string, first_fault string"
FAULTS = (None, "blank", "duplicate", "truncated")


def _measures(part: pa.Table, codes: np.ndarray, row: np.ndarray) -> dict:
    """Counts of one stretch of a conversation."""
    fault, copies = part.column("fault").to_numpy(), part.column("copies").to_numpy()
    turn = part.column("turn").drop_null().to_numpy()
    initial = codes & 3
    pairs = initial[:-1] * 4 + initial[1:]
    return {"least": int(turn[0]) if len(turn) else None, "most": int(turn[-1]) if len(turn) else None,
            "turns": int((turn[1:] != turn[:-1]).sum()) + (len(turn) > 0),
            "blank": int(copies[fault == BLANK].sum()), "truncated": int((fault == SHORT).sum()),
            "duplicate": int(copies[fault != BLANK].sum() - ((fault == NONE) | (fault == SHORT)).sum()),
            "illegal": int((~np.isin(pairs, [a * 4 + b for a, b in LEGAL])).sum()),
            "first": int(initial[0]), "last": int(initial[-1])}


def _lines(part: pa.Table, row: np.ndarray, letters: list, state: int, last: bool):
    """(letter, role, text, row of the part or None) per edit, in order."""
    roles, texts = part.column("role").to_pylist(), part.column("text").to_pylist()
    for r, own in zip(row.tolist(), letters):
        for letter in own:
            if letter == "D":
                yield letter, roles[r], texts[r], r
            elif letter == "I":
                yield letter, ROLE[state], "", None
                state = TURN[state]
            elif letter == "R":
                yield letter, ROLE[state], texts[r], r
                state = TURN[state]
            else:
                yield letter, roles[r], texts[r], r
                state = KEPT[state, INITIALS.index(roles[r][:1])]
    if last:
        for role in Edits.ending(state)[1]:
            yield "I", role, "", None


def _walks(starts, piece: int, table: pa.Table):
    """(conversation, part, codes, row, letters, first state, is the last part,
    is whole) of each stretch of a piece."""
    edits, stretches = Edits(), _stretches(table)
    for k, (conv, a, b) in enumerate(stretches):
        side = 2 if len(stretches) == 1 else 0 if k == 0 else 1 if k == len(stretches) - 1 else None
        whole = (piece, side) not in starts
        state, end, last = (START, END, True) if whole else starts[piece, side]
        part = table.slice(a, b - a)
        codes, row = _codes(part)
        yield conv, part, codes, row, edits.walk(codes.tolist(), end, state)[0], state, last, whole


def _audits(starts):
    """Kernel: a row per whole conversation, and rows with repaired text for
    the parts of split ones."""

    def run(batches):
        table = _piece(batches)
        if table is None:
            return
        piece, out = table.column(PIECE)[0].as_py(), []
        for conv, part, codes, row, letters, state, last, whole in _walks(starts.value, piece, table):
            own = _measures(part, codes, row)
            audit, body, short = "".join(letters), [], 0
            fault = part.column("fault").to_numpy()
            for letter, role, text, r in _lines(part, row, letters, state, last):
                if letter != "D":
                    body.append(f"{role}:{text}".encode())
                    short += r is not None and fault[r] == SHORT
            audit += "I" * (len(body) - sum(audit.count(x) for x in "IKR"))  # those after the last turn
            own["cost"] = DELETE * audit.count("D") + INSERT * audit.count("I") + REROLE * audit.count("R") + TRUNCATED * int(short)
            base = {"conv_id": conv, "piece": piece, "part": 0, **own, "audit": audit}
            if whole:
                out.append(base | {"repaired_sha256": hashlib.sha256(b"\n".join(body)).hexdigest()})
                continue
            held, size, k = [], 0, 0
            for line in body:
                held.append(line)
                size += len(line)
                if size >= BODY_BYTES:
                    out.append((base if k == 0 else {"conv_id": conv, "piece": piece, "part": k}) | {"repaired": b"\n".join(held)})
                    held, size, k = [], 0, k + 1
            if held or k == 0:
                out.append((base if k == 0 else {"conv_id": conv, "piece": piece, "part": k}) | ({"repaired": b"\n".join(held)} if held else {}))
        kinds = {"conv_id": pa.int64(), "piece": pa.int32(), "part": pa.int32(), "least": pa.int64(), "most": pa.int64(),
                 **{c: pa.int64() for c in COUNTS}, "first": pa.int32(), "last": pa.int32(), "audit": pa.string(), "repaired": pa.binary(),
                 "repaired_sha256": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in out], t) for c, t in kinds.items()], names=list(kinds))

    return run


def _turns(starts):
    """Kernel: a row per edit."""

    def run(batches):
        table = _piece(batches)
        if table is None:
            return
        piece, place = table.column(PIECE)[0].as_py(), 0
        for conv, part, _, row, letters, state, last, _ in _walks(starts.value, piece, table):
            fault, seen = part.column("fault").to_pylist(), set()
            rows = []
            for letter, role, text, r in _lines(part, row, letters, state, last):
                own = None if r is None else fault[r] if r not in seen or fault[r] == BLANK else DUPLICATE
                seen.add(r)
                rows.append((conv, piece, place, letter, role, text, None if own is None else FAULTS[own]))
                place += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), *[pa.string()] * 4))],
                names=["conv_id", "piece", "place", "edit", "role", "text", "first_fault"])

    return run


def _joined(batches):
    """Kernel over the parts of split conversations, sorted by conversation,
    piece and part: their rows, the digest fed part by part."""
    now = None

    def done():
        gaps = now["most"] - now["least"] + 1 - now["turns"] if now["least"] is not None else 0
        row = {"conv_id": now["conv_id"], "gaps": gaps, **{c: now[c] for c in COUNTS[1:]}, "audit": "".join(now["audit"]),
               "repaired_sha256": now["sha"].hexdigest()}
        return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in row.values()], names=list(row))

    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if now is None or row["conv_id"] != now["conv_id"]:
                if now is not None:
                    yield done()
                now = {"conv_id": row["conv_id"], "least": None, "most": None, "last": None, "audit": [], "sha": hashlib.sha256(), "lines": False,
                       **dict.fromkeys(COUNTS, 0)}
            if row["part"] == 0:
                for c in COUNTS:
                    now[c] += row[c]
                now["turns"] -= row["least"] is not None and row["least"] == now["most"]
                now["illegal"] += now["last"] is not None and (now["last"], row["first"]) not in LEGAL
                now["least"] = row["least"] if now["least"] is None else now["least"]
                now["most"] = now["most"] if row["most"] is None else row["most"]
                now["last"] = row["last"]
                now["audit"].append(row["audit"])
            if row["repaired"] is not None:
                now["sha"].update((b"\n" if now["lines"] else b"") + row["repaired"])
                now["lines"] = True
    if now is not None:
        yield done()


def _sorted(conversations: DataFrame, piece_bytes: int) -> DataFrame:
    """Distinct turns with their number of copies and first fault, in sorted pieces."""
    spark = conversations.sparkSession
    text = F.coalesce(F.col("text"), F.lit(" "))
    role = F.coalesce(F.col("role"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("role") + 48)).first()[0] or 0
    pieces = max(math.ceil(size / piece_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    order = F.struct(F.col("turn").isNotNull(), "turn")
    # what is said at several turns, without its text
    said = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.unhex(F.sha2("text", 256)).alias("d")).agg(
        F.min(order).alias("earliest"), F.max(order).alias("latest")).filter("earliest <> latest").drop("latest")
    marked = groups.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    fault = (F.when(~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), BLANK).when(F.col("earliest").isNotNull() & ~order.eqNullSafe(F.col("earliest")), DUPLICATE)
             .when(~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), SHORT).otherwise(NONE))
    slim = marked.select("conv_id", "turn", "role", "text", "copies", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    return sorted_pieces(slim, ["conv_id", "turn", F.substring("role", 1, PREFIX), F.substring("text", 1, PREFIX)], ["conv_id", "turn", "role", "text"], pieces)


def _planned(conversations: DataFrame, piece_bytes: int):
    """(sorted pieces, broadcast starts of the parts of split conversations)."""
    spark = conversations.sparkSession
    rows = _sorted(conversations, piece_bytes)
    slim = rows.select("conv_id", "initial", "fault", "copies", PIECE)
    edges = sorted((r.asDict() for r in slim.mapInArrow(_edges, EDGES).collect()), key=lambda r: (r["piece"], r["side"]))
    ends = _ends(edges)
    got = slim.mapInArrow(_arrivals(spark.sparkContext.broadcast(ends)), "conv_id long, piece int, side int, states array<int>").collect() if ends else []
    starts = _starts(edges, ends, {(r["piece"], r["side"]): r["states"] for r in got})
    return rows, spark.sparkContext.broadcast(starts)


def audit(conversations: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Per conversation of (conv_id, turn, role, text): gaps, faults and the
    cheapest repair.

    Turns are taken by turn number (null first), those of one number by role,
    then text, in UTF-8 order. A null role or text is one space; a null conv_id
    is a conversation of its own. A turn's first fault counts: blank (nothing
    but white space), duplicate (role and text stood earlier; of equal rows all
    but the first), truncated (does not end in ``.``, ``!`` or ``?``). ``gaps``
    are the turn numbers missing between the smallest and the largest, 0 if all
    are null; ``illegal`` are adjacent role initials other than su, ua, au.
    ``cost`` and ``audit`` are those of the cheapest edits, ASCII-least among
    equals; ``repaired_sha256`` is the digest of the repaired ``role:text``
    lines. Roles of other initials, the empty one too, can only be reroled or
    deleted. Other columns are ignored; an empty table gives no rows.

    The digest of a conversation in several pieces is fed with their texts one
    after the other by one task, as SHA-256 demands; only that task's part in
    hand, of at most ``BODY_BYTES`` and a line, is in its memory."""
    rows, starts = _planned(conversations, piece_bytes)
    parts = rows.mapInArrow(_audits(starts), PARTS)
    if not starts.value:
        return _finished(parts)
    whole = _finished(parts.filter("repaired_sha256 is not null"))
    split = parts.filter("repaired_sha256 is null").repartition("conv_id").sortWithinPartitions("conv_id", "piece", "part")
    return whole.union(split.drop("repaired_sha256").mapInArrow(_joined, AUDIT))


def _finished(parts: DataFrame) -> DataFrame:
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    return parts.select("conv_id", gaps.alias("gaps"), *COUNTS[1:], "audit", "repaired_sha256")


def repaired(conversations: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The edits themselves, a row each: conv_id, (piece, place) which order
    them, edit (D, I, K or R), role and text after it (of deleted turns, their
    own), first_fault (null for none). The rows other than D are the repaired
    conversations. Inputs as in ``audit``."""
    rows, starts = _planned(conversations, piece_bytes)
    return rows.mapInArrow(_turns(starts), TURNS)
