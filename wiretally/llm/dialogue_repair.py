"""Least edits that give a conversation the structure (system? (user assistant)+)?, by a Viterbi search whose survivors coalesce.

States: nothing yet (0), after the system turn (1), after a user turn (2), after an assistant turn (3). Edits: Keep costs 0, Rerole to
user or assistant 3, Delete 4, Insert an empty user or assistant turn 3; a truncated turn that stays costs 3 more. Blank and repeated
turns must be deleted. State and edit say which role a turn has, so the edits' initials say all; of equal costs the least
string of initials in ASCII wins.

* ``Survivors`` holds the best path to each state as a tree of edit strings with reference counts: a node counts its children, a
  branch without children goes, a node with one child is joined with it, and what all paths share is given out. So there are at
  most seven nodes, which hold what is undecided. A path that another one can only better, whatever comes, ends too. Paths of equal cost are compared over all that is undecided: of two paths to
  different states over the same turns none begins the other, so their order, once known, stays, and is carried along as a rank.
* A conversation need not lie in one task. Turns (role initial, faults and copies only) are dealt out by ranges of (conversation,
  turn, role, digest), so a conversation with a third of all rows is cut into many pieces. A piece that may go on an earlier one
  is searched from all four states; the piece is then a step of its own from state to state with a cost and an edit string, and
  the same survivors run over the pieces. Only here, and for the digest of the repaired text (which is sequential by its
  definition), a conversation comes in one stream, of which one row is held at a time besides the edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import written

SPACE = " \t\n\x0b\x0c\r"
STATES = range(4)
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}  # state after a turn of a role
KEEP, REROLE, INSERT, DELETE, STAYS_TRUNCATED = 0, 3, 3, 4, 3
#: A deletion that is required; before D in ASCII, as every other edit that may stand in its place is behind D.
FORCED = "@"


def _inserted() -> list[list[tuple[int, int, str]]]:
    """From each state: (state, cost, edits) after no, one or two insertions; more would only go in a circle."""
    out = []
    for state in STATES:
        steps, now = [(state, 0, "")], state
        for k in (1, 2):
            now = AFTER[now, "a" if now == 2 else "u"]
            steps.append((now, INSERT * k, "I" * k))
        out.append(steps)
    return out


INSERTED = _inserted()


def _steps(initial: str, truncated: bool, forced: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits): the best way over one turn between each two states, insertions before it included."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for source in STATES:
        for state, cost, edits in INSERTED[source]:
            ways = [(state, DELETE, FORCED if forced else "D")]
            if not forced:
                stays = STAYS_TRUNCATED if truncated else 0
                if (state, initial) in AFTER:
                    ways.append((AFTER[state, initial], KEEP + stays, "K"))
                ways.append((AFTER[state, "a" if state == 2 else "u"], REROLE + stays, "R"))
            for target, more, edit in ways:
                way = (cost + more, edits + edit)
                best[source, target] = min(best.get((source, target), way), way)
    return [(source, target, *way) for (source, target), way in best.items()]


_known: dict[tuple[str, bool, bool], list[tuple[int, int, int, str]]] = {}


def steps(initial: str, truncated: bool, forced: bool) -> list[tuple[int, int, int, str]]:
    """The same, remembered; all roles that no state takes are one."""
    key = ("" if forced or initial not in "sua" else initial, truncated and not forced, forced)
    if key not in _known:
        _known[key] = _steps(*key)
    return _known[key]


#: The end: what must be inserted to be allowed to stop.
ENDS = [(0, 0, 0, ""), (1, 0, 2 * INSERT, "II"), (2, 0, INSERT, "I"), (3, 0, 0, "")]


def _no_worse() -> dict[tuple[int, int], int]:
    """(i, j): what it costs at most to do from state i all that can still be done from state j. After an assistant turn all goes that
    goes after a system turn, and all that goes at the start if a system turn that is kept there is deleted instead."""
    cost = {(source, state): c for source in STATES for state, c, _ in INSERTED[source]} | {(3, 1): 0, (3, 0): DELETE}
    for via in STATES:
        for i in STATES:
            for j in STATES:
                if (i, via) in cost and (via, j) in cost:
                    cost[i, j] = min(cost.get((i, j), 10 ** 9), cost[i, via] + cost[via, j])
    return {(i, j): c for (i, j), c in cost.items() if i != j}


NO_WORSE = _no_worse()


class Node:
    """A stretch of edits that some paths share; ``children`` is the reference count."""

    __slots__ = ("parent", "edits", "children")

    def __init__(self, parent: Node | None, edits: str):
        self.parent, self.edits, self.children = parent, bytearray(edits, "ascii"), []


class Survivors:
    """Least-cost path to each state. ``settled``: edits given out since they were last taken."""

    def __init__(self, start: int):
        self.root = Node(None, "")
        self.paths = {start: (0, self.root)}  # state -> (cost, leaf), in the order of the paths' edit strings
        self.settled = bytearray()

    def step(self, ways: list[tuple[int, int, int, str]]) -> None:
        rank = {state: k for k, state in enumerate(self.paths)}
        best: dict[int, tuple[int, int, str, int]] = {}
        for source, target, cost, edits in ways:
            if source in rank:
                way = (self.paths[source][0] + cost, rank[source], edits, source)
                if target not in best or way < best[target]:
                    best[target] = way
        # A path that another can only better, whatever comes, is no survivor; equal costs stay.
        best = {j: way for j, way in best.items() if not any(best[i][0] + NO_WORSE[i, j] < way[0] for i in best if (i, j) in NO_WORSE)}
        chosen: dict[int, list[int]] = {}
        for target, way in best.items():
            chosen.setdefault(way[3], []).append(target)
        for source in [x for x in self.paths if x not in chosen]:
            self._drop(self.paths.pop(source)[1])
        leaves = {}
        for source, targets in chosen.items():
            leaf = self.paths[source][1]
            if len(targets) == 1:  # goes on in place
                leaf.edits += best[targets[0]][2].encode()
                leaves[targets[0]] = leaf
            else:
                leaf.children = [Node(leaf, best[t][2]) for t in targets]
                leaves.update(zip(targets, leaf.children, strict=True))
        self.paths = {t: (best[t][0], leaves[t]) for t in sorted(best, key=lambda t: best[t][1:3])}
        self._settle()

    def forced(self, n: int) -> None:
        """n required deletions. What is inserted among them comes before the last one: @ is less than I."""
        if n > 1:
            for state, (cost, leaf) in self.paths.items():
                leaf.edits += FORCED.encode() * (n - 1)
                self.paths[state] = (cost + DELETE * (n - 1), leaf)
        if n:
            self.step(steps("", False, True))

    def _drop(self, node: Node) -> None:
        """A path ends: its branch goes, and a parent with one child left is joined with it."""
        parent = node.parent
        if parent is None:
            return
        parent.children.remove(node)
        if not parent.children:
            self._drop(parent)
        elif len(parent.children) == 1:
            child = parent.children[0]
            parent.edits += child.edits
            parent.children = child.children
            for x in child.children:
                x.parent = parent
            for state, (cost, leaf) in self.paths.items():
                if leaf is child:
                    self.paths[state] = (cost, parent)

    def _settle(self) -> None:
        self.settled += self.root.edits
        self.root.edits.clear()

    def take(self) -> str:
        out = self.settled.decode()
        self.settled.clear()
        return out

    def undecided(self, state: int) -> str:
        node, parts = self.paths[state][1], []
        while node is not None:
            parts.append(node.edits)
            node = node.parent
        return b"".join(reversed(parts)).decode()


def least_edits(turns: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and edits of one conversation of (role initial, truncated, must go)."""
    found = Survivors(0)
    for initial, truncated, forced in turns:
        found.step(steps(initial, truncated, forced))
    found.step(ENDS)
    return found.paths[0][0], found.take()


def turns_of(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """(conv_id, turn, role, text, copies, digest, blank, truncated); null roles and texts become one space. ``damage`` spoils a fifth
    of the rows, by a hash of conversation and turn: dropped, emptied, end marks gone, repeated, all of them the user's."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"))
    if damage:
        code = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                                F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
        rows = rows.withColumn("code", code).where("code <> 0").select(
            "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.when(F.col("code") == 3, 2).otherwise(1).alias("copies"))
    end = F.rtrim("text", F.lit(SPACE))
    return rows.withColumns({"digest": F.unhex(F.sha2("text", 256)), "blank": end == "", "truncated": ~F.right(end, F.lit(1)).isin(".", "!", "?")})


def _first_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, text): of equal roles and texts that are not blank the first one of a conversation."""
    return turns.where("not blank").groupBy("conv_id", "role", "digest").agg(
        F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unnumbered"), F.first("text").alias("text")).select(
        "conv_id", F.expr("CASE WHEN NOT unnumbered THEN least END").alias("turn"), "role", "digest", "text")


ORDER = ["conv_id", "turn", "role", "digest"]
LEGAL = ("su", "ua", "au")
COUNTS = "blank long, duplicate long, truncated long, illegal long"
ENDS_OF_PIECE = "first_role string, last_role string, first_turn long, last_turn long, least long, most long, numbers long"
WAYS = "array<struct<source:int,target:int,cost:long,edits:string>>"


class Piece:
    """Consecutive turns of one conversation: what is counted of them and the survivors from each state it may begin in."""

    def __init__(self, conv_id: object, starts: tuple[int, ...]):
        self.conv_id, self.searches = conv_id, {s: Survivors(s) for s in starts}
        self.settled = dict.fromkeys(starts, "")
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.roles: list[str] = []  # initials of the first and of the last turn
        self.turns: list[int | None] = []
        self.least = self.most = None
        self.numbers = 0

    def add(self, turn: int | None, initial: str, copies: int, blank: bool, truncated: bool, first: bool) -> None:
        counts = self.counts
        if self.roles:
            counts["illegal"] += self.roles[-1] + initial not in LEGAL
        counts["illegal"] += copies - 1
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.numbers += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        self.roles, self.turns = [*self.roles[:1], initial], [*self.turns[:1], turn]
        if len(self.roles) == 1:
            self.roles, self.turns = [initial] * 2, [turn] * 2
        counts["blank"] += copies if blank else 0
        counts["duplicate"] += 0 if blank else copies - first
        counts["truncated"] += bool(not blank and first and truncated)
        stays = first and not blank
        for search in self.searches.values():
            if stays:
                search.step(steps(initial, truncated, False))
            search.forced(copies - stays)

    def row(self, number: int) -> dict:
        ways = []
        for source, search in self.searches.items():
            settled = search.take()
            if self.roles:
                ways += [{"source": source, "target": t, "cost": cost, "edits": settled + search.undecided(t)} for t, (cost, _) in search.paths.items()]
        roles, turns = self.roles or [None] * 2, self.turns or [None] * 2
        return {"conv_id": self.conv_id, "piece": number, **self.counts, "first_role": roles[0], "last_role": roles[1], "first_turn": turns[0],
                "last_turn": turns[1], "least": self.least, "most": self.most, "numbers": self.numbers, "ways": ways}


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _pieces(conversations: DataFrame, turns: DataFrame, firsts: DataFrame) -> DataFrame:
    """Per conversation and task: what a piece counts and its best ways from state to state."""
    alike = turns.groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    # Marks go before the rows they speak of: one for a conversation, one for a first turn.
    marks = firsts.select("conv_id", "turn", "role", "digest", F.lit(0).alias("kind"))
    names = conversations.groupBy("conv_id").agg(F.lit(-1).alias("kind"))
    rows = alike.withColumn("kind", F.lit(1)).unionByName(marks, allowMissingColumns=True).unionByName(names, allowMissingColumns=True)
    rows = rows.repartitionByRange(_partitions(rows), *ORDER).sortWithinPartitions(*ORDER, "kind")
    columns = [*ORDER, "copies", "blank", "truncated", "kind"]
    schema = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, piece int, {COUNTS}, {ENDS_OF_PIECE}, ways {WAYS}"
    arrow = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, out, now, marked = TaskContext.get().partitionId(), [], None, None
        for batch in batches:
            for conv_id, turn, role, digest, copies, blank, truncated, kind in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.row(number))
                    now = Piece(conv_id, tuple(STATES) if now is None else (0,))
                if kind == 1:
                    now.add(turn, role[:1], copies, blank, truncated, marked == (turn, role, digest))
                marked = (turn, role, digest) if kind == 0 else None
            yield pa.RecordBatch.from_pylist(out, arrow)
            out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row(number)], arrow)

    return rows.mapInArrow(run, schema)


def _edits(pieces: DataFrame) -> DataFrame:
    """(conv_id, gaps, counts, cost, edits) per conversation, from its pieces in order."""
    schema = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, gaps long, {COUNTS}, cost long, edits string"
    arrow = pieces.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, search = None, None

        def closed() -> dict:
            search.step(ENDS)
            gaps = now["most"] - now["least"] + 1 - now["numbers"] if now["numbers"] else 0
            return {**{c: now[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal")}, "gaps": gaps,
                    "cost": search.paths[0][0], "edits": search.take()}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if now is None or now["conv_id"] != row["conv_id"]:
                    if now is not None:
                        out.append(closed())
                    now, search = row, Survivors(0)
                elif row["last_role"] is not None:
                    for c in ("blank", "duplicate", "truncated", "illegal", "numbers"):
                        now[c] += row[c]
                    now["illegal"] += now["last_role"] is not None and now["last_role"] + row["first_role"] not in LEGAL
                    now["numbers"] -= row["first_turn"] is not None and now["last_turn"] == row["first_turn"]
                    now.update(least=row["least"] if now["least"] is None else now["least"], most=now["most"] if row["most"] is None else row["most"],
                               last_role=row["last_role"], last_turn=row["last_turn"])
                if row["ways"]:
                    search.step([(w["source"], w["target"], w["cost"], w["edits"]) for w in row["ways"]])
            yield pa.RecordBatch.from_pylist(out, arrow)
        if now is not None:
            yield pa.RecordBatch.from_pylist([closed()], arrow)

    return pieces.repartition(_partitions(pieces), "conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(run, schema)


def _edited(conversations: DataFrame, damage: bool) -> tuple[DataFrame, DataFrame]:
    """The edits of each conversation, and behind them (kind 1) its turns that may stay, conversation by conversation, in order."""
    turns = turns_of(conversations, damage)
    firsts = written(_first_turns(turns), "first-turns")
    edits = written(_edits(_pieces(conversations, turns, firsts)), "edits")
    both = edits.select("conv_id", "edits", F.lit(0).alias("kind")).unionByName(firsts.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return edits, both.repartition(_partitions(both), "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")


class Replay:
    """Carries out the edits of one conversation on its turns, one by one; required deletions are of turns that don't come."""

    def __init__(self, conv_id: object, edits: str):
        self.conv_id, self.edits, self.at, self.state = conv_id, edits.replace(FORCED, ""), 0, 0

    def inserted(self) -> list[tuple[str, str]]:
        """(edit, role) of the turns that are put in here."""
        out = []
        while self.edits[self.at:self.at + 1] == "I":
            out.append(("I", self._role()))
            self.at += 1
        return out

    def turn(self, role: str) -> tuple[str, str]:
        """Edit and role of the turn that comes now."""
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.state = AFTER[self.state, role[:1]]
            return edit, role
        return (edit, self._role()) if edit == "R" else (edit, role)

    def _role(self) -> str:
        role = "assistant" if self.state == 2 else "user"
        self.state = AFTER[self.state, role[0]]
        return role


def repaired_turns(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """(conv_id, turn, edit, role, text): the repaired turns, those put in with an empty text and no turn number, and those rerolled,
    with the edit that made them (K, R, I). Turns that were deleted don't come. Rows of a conversation come in order in one
    partition. Nulls, ties and the like as in ``repair_digests``."""
    _, rows = _edited(conversations, damage)
    schema = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, turn long, edit string, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = None
        for batch in batches:
            out = []
            for conv_id, edits, kind, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edits", "kind", "turn", "role", "text")), strict=True):
                if kind == 0:
                    if replay is not None:
                        out += [(replay.conv_id, None, *x, "") for x in replay.inserted()]
                    replay = Replay(conv_id, edits)
                else:
                    out += [(conv_id, None, *x, "") for x in replay.inserted()]
                    edit, role = replay.turn(role)
                    if edit != "D":
                        out.append((conv_id, turn, edit, role, text))
            yield _columns(out, batch.schema.field("conv_id").type)
        if replay is not None:
            yield _columns([(replay.conv_id, None, *x, "") for x in replay.inserted()], batch.schema.field("conv_id").type)

    return rows.mapInArrow(run, schema)


def _columns(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [conv, pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "turn", "edit", "role", "text"])


def repair_digests(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conv_id of ``conversations``.

    Null roles and texts count as one space, so a null role is no role and must be changed or deleted, and a null text is blank. Null turns
    come first; a null conv_id is a conversation of its own. Rows with equal turns go by role, then by the SHA-256 of the
    text; repeated rows stand side by side and all but the first are duplicates. Extra columns are not read, whatever their
    names. An empty table gives no rows; a conversation that the damage leaves empty gives zeros and empty texts."""
    edits, rows = _edited(conversations, damage)
    arrow = edits.select("conv_id").limit(0).toArrow().schema.field("conv_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, digest, lines = None, None, 0

        def line(role: str, text: str) -> None:
            nonlocal lines
            digest.update(b"\n" * (lines > 0) + f"{role}:{text}".encode())
            lines += 1

        def closed() -> tuple:
            for _, role in replay.inserted():
                line(role, "")
            return replay.conv_id, digest.hexdigest()

        def made(out: list[tuple]) -> pa.RecordBatch:
            conv_ids, digests = list(zip(*out, strict=True)) or [()] * 2
            return pa.RecordBatch.from_arrays([pa.array(conv_ids, arrow), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"])

        for batch in batches:
            out = []
            for conv_id, edits, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edits", "kind", "role", "text")), strict=True):
                if kind == 0:
                    if replay is not None:
                        out.append(closed())
                    replay, digest, lines = Replay(conv_id, edits), hashlib.sha256(), 0
                else:
                    for _, put in replay.inserted():
                        line(put, "")
                    edit, role = replay.turn(role)
                    if edit != "D":
                        line(role, text)
            yield made(out)
        if replay is not None:
            yield made([closed()])

    digests = rows.mapInArrow(run, f"conv_id {edits.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")
    return edits.join(digests.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.translate("edits", FORCED, "D").alias("audit"), "repaired_sha256")
