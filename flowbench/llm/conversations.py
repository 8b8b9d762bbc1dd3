"""Repairing the structure of conversations by the cheapest edits, as their turns stream by.

A conversation is whole if its role initials read ``s?(ua)+`` or there are none. Edits keep (K), rerole (R) or delete (D) a
row, or insert an empty one (I). A Viterbi search over four states (nothing yet, after s, after u, after a) keeps one
survivor a state: the cheapest edits that lead there, of equal cost the ASCII-least. Survivors are paths in a tree of
backpointers with reference counts; once all survivors share an ancestor the edits up to it are given out and freed, so
that memory holds the unresolved end alone. Survivors of equal cost are compared by all that is unresolved of them; jump
pointers find the place where two paths part in logarithmic time, so long ties cost little.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed white space that leaves a text blank, and signs that end one.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
FAULTS = NONE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
#: Fixed costs: rerole, delete, insert, keep or rerole a truncated row.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
STATES, ACCEPTING = 4, (0, 3)
#: The state after a role initial, for each state; where an inserted row leads is where the role that comes next does.
#: An empty role has no initial and leads nowhere else.
STEPS = ({"s": 1, "u": 2, "": 0}, {"u": 2, "": 1}, {"a": 3, "": 2}, {"u": 2, "": 3})
NEXT = (("u", "user"), ("u", "user"), ("a", "assistant"), ("u", "user"))
#: How much more than state t (column) state s (row) may cost and yet win: what t pays at most to follow any end that s can have.
LEAD = ((0, 10, 7, 2), (0, 0, 5, 0), (5, 5, 0, 5), (0, 10, 5, 0))


class Tree:
    """Backpointers of edits in flat arrays; a node lives as long as a survivor or a child refers to it."""

    def __init__(self) -> None:
        self.parent, self.jump, self.far, self.depth, self.refs = (array("q") for _ in range(5))
        self.letter, self.free, self.root = bytearray(), [], 0
        self.root = self._new()

    def _new(self) -> int:
        if self.free:
            return self.free.pop()
        for a in (self.parent, self.jump, self.far, self.depth, self.refs):
            a.append(0)
        self.letter.append(0)
        return len(self.letter) - 1

    def add(self, above: int, letter: int) -> int:
        """A child of a node; its jump pointer leads to an ancestor at a distance that doubles with depth."""
        node, top = self._new(), self.depth[self.root]
        self.parent[node], self.letter[node], self.depth[node], self.refs[node] = above, letter, self.depth[above] + 1, 0
        self.refs[above] += 1
        over = self.jump[above]
        if above != self.root and self.far[above] >= top and over != self.root and self.depth[above] - self.far[above] == self.far[above] - self.far[over]:
            self.jump[node], self.far[node] = self.jump[over], self.far[over]
        else:
            self.jump[node], self.far[node] = above, self.depth[above]
        return node

    def drop(self, node: int) -> None:
        """One reference less; nodes that nothing refers to are free."""
        self.refs[node] -= 1
        while node != self.root and not self.refs[node]:
            self.free.append(node)
            node = self.parent[node]
            self.refs[node] -= 1

    def at(self, node: int, depth: int) -> int:
        """The ancestor at a depth, which is not above the root's."""
        while self.depth[node] > depth:
            node = self.jump[node] if self.far[node] >= depth else self.parent[node]
        return node

    def less(self, a: int, x: int, b: int, y: int) -> bool:
        """Whether the path to a and letter x is less than that to b and letter y."""
        if a == b:
            return x < y
        depth = min(self.depth[a], self.depth[b])
        p, q = self.at(a, depth), self.at(b, depth)
        if p == q:  # one path goes on where the other ends
            if depth == self.depth[a]:
                return x <= self.letter[self.at(b, depth + 1)]
            return self.letter[self.at(a, depth + 1)] < y
        top = self.depth[self.root]
        while self.parent[p] != self.parent[q]:
            far = self.far[p]
            if far == self.far[q] and far >= top and self.jump[p] != self.jump[q]:
                p, q = self.jump[p], self.jump[q]
            else:
                p, q = self.parent[p], self.parent[q]
        return self.letter[p] < self.letter[q]

    def advance(self, survivor: int) -> int:
        """Moves the root one step towards a survivor and gives that edit; the old root is free."""
        old, self.root = self.root, self.at(survivor, self.depth[self.root] + 1)
        self.free.append(old)
        return self.letter[self.root]


class Pending:
    """Rows in the order in which they came, those beyond a number of bytes on disk."""

    def __init__(self, most: int = 1 << 22) -> None:
        self.rows, self.bytes, self.most, self.spilled, self.read, self.left = deque(), 0, most, None, 0, 0

    def push(self, row: tuple[str, str]) -> None:
        if self.left or self.bytes > self.most:
            if self.spilled is None:
                self.spilled = tempfile.TemporaryFile()
            self.spilled.seek(0, 2)
            pickle.dump(row, self.spilled)
            self.left += 1
        else:
            self.rows.append(row)
            self.bytes += len(row[1])

    def pop(self) -> tuple[str, str]:
        if self.rows:
            row = self.rows.popleft()
            self.bytes -= len(row[1])
            return row
        self.spilled.seek(self.read)
        row = pickle.load(self.spilled)  # noqa: S301
        self.read, self.left = self.spilled.tell(), self.left - 1
        if not self.left:
            self.spilled.close()
            self.spilled, self.read = None, 0
        return row


class Repair:
    """The search over one conversation. add() and finish() give the edits that are certain: letter, role and text."""

    def __init__(self, most: int = 1 << 22) -> None:
        self.tree, self.pending, self.state = Tree(), Pending(most), 0
        self.nodes, self.costs = [self.tree.root, -1, -1, -1], [0, None, None, None]
        self.tree.refs[self.tree.root] += 1
        self._insert()

    def _insert(self) -> None:
        """Survivors that are better with a row inserted after them, and none that can't win any more."""
        nodes, costs, tree = self.nodes, self.costs, self.tree
        for to, sources in ((2, (0, 1, 3)), (3, (2,))):
            best = (costs[to], nodes[to], None)
            for s in sources:
                if costs[s] is not None:
                    cost = costs[s] + INSERT
                    if best[0] is None or cost < best[0] or cost == best[0] and self._before(nodes[s], b"I"[0], best):
                        best = (cost, nodes[s], b"I"[0])
            if best[2] is not None:
                node = tree.add(best[1], best[2])
                tree.refs[node] += 1
                if costs[to] is not None:
                    tree.drop(nodes[to])
                nodes[to], costs[to] = node, best[0]
        for s in range(STATES):
            if costs[s] is not None and any(costs[t] is not None and costs[s] > costs[t] + LEAD[s][t] for t in range(STATES)):
                tree.drop(nodes[s])
                nodes[s], costs[s] = -1, None

    def _before(self, node: int, letter: int, best: tuple) -> bool:
        """Whether a path and a letter are less than the best; a best without a letter ends in its node's own."""
        if best[2] is None:
            return self.tree.less(node, letter, self.tree.parent[best[1]], self.tree.letter[best[1]])
        return self.tree.less(node, letter, best[1], best[2])

    def add(self, role: str, text: str, fault: int) -> Iterator[tuple[str, str, str]]:
        """One more row."""
        initial, tree, best = role[:1], self.tree, [None] * STATES
        extra = CUT if fault == TRUNCATED else 0

        def offer(to: int | None, cost: int, node: int, letter: int) -> None:
            if to is not None and (best[to] is None or cost < best[to][0] or cost == best[to][0] and tree.less(node, letter, best[to][1], best[to][2])):
                best[to] = (cost, node, letter)

        for s in range(STATES):
            if self.costs[s] is not None:
                cost, node = self.costs[s], self.nodes[s]
                offer(s, cost + DELETE, node, b"D"[0])
                if fault not in (BLANK, DUPLICATE):
                    offer(STEPS[s].get(initial), cost + extra, node, b"K"[0])
                    offer(STEPS[s][NEXT[s][0]], cost + extra + REROLE, node, b"R"[0])
        self.pending.push((role, text))
        old, self.nodes, self.costs = self.nodes, [-1] * STATES, [None] * STATES
        for s, found in enumerate(best):
            if found is not None:
                self.costs[s], self.nodes[s] = found[0], tree.add(found[1], found[2])
                tree.refs[self.nodes[s]] += 1
        for node in old:
            if node >= 0:
                tree.drop(node)
        self._insert()
        while tree.refs[tree.root] == 1 and tree.root not in self.nodes:
            yield self._edit(tree.advance(next(n for n in self.nodes if n >= 0)))

    def finish(self) -> Iterator[tuple[str, str, str]]:
        """The edits that are left; the cost is then that of the whole conversation."""
        best = None
        for s in ACCEPTING:
            if self.costs[s] is not None and (best is None or self.costs[s] < best[0] or self.costs[s] == best[0] and self._before(self.tree.parent[self.nodes[s]], self.tree.letter[self.nodes[s]], (*best, None))):
                best = (self.costs[s], self.nodes[s])
        self.cost = best[0]
        while self.tree.root != best[1]:
            yield self._edit(self.tree.advance(best[1]))

    def _edit(self, letter: int) -> tuple[str, str, str]:
        edit, (initial, due) = chr(letter), NEXT[self.state]
        role, text = (due, "") if edit == "I" else self.pending.pop()
        if edit == "D":
            return edit, role, text
        if edit == "K":
            initial = role[:1]
        self.state = STEPS[self.state][initial]
        return edit, role if edit == "K" else due, text


def prepared(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, fault``: each conversation in one partition, in order of turn (nulls first), role and text.

    Copies are found by 128 bits of hash, before rows stream, so that no task keeps the texts of a conversation. One
    exchange deals the rows; window and order sort within partitions and spill.
    """
    space, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space.alias("role"), text.alias("text"))
    rows = rows.repartition("conv_id").withColumn("a", F.xxhash64("text")).withColumn("b", F.xxhash64(F.lit(1), "text"))
    rows = rows.withColumn("seen", F.row_number().over(W.partitionBy("conv_id", "role", "a", "b").orderBy(F.asc_nulls_first("turn"))))
    bare = F.btrim("text", F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.right(bare, F.lit(1)).isin(*ENDS), TRUNCATED).otherwise(NONE)
    rows = rows.select("conv_id", "turn", "role", "text", fault.alias("fault"), "seen")
    return rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "seen").drop("seen")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def edits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Events of prepared() rows: (id, "edit", (letter, role, text)) and, at a conversation's end, (id, "end", its counts)."""
    repair, own, counts = None, None, {}

    def end() -> Iterator[tuple]:
        yield from ((own, "edit", e) for e in repair.finish())
        turns = counts["turns"]
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        yield own, "end", (gaps, *counts["faults"][1:], counts["illegal"], repair.cost)

    for conv_id, turn, role, text, fault in rows_of(batches):
        if repair is None or conv_id != own:
            if repair is not None:
                yield from end()
            repair, own, counts, before = Repair(), conv_id, {"faults": [0] * 4, "illegal": 0, "turns": None}, None
        counts["faults"][fault] += 1
        counts["illegal"] += before is not None and before + role[:1] not in ("su", "ua", "au")
        before = role[:1]
        if turn is not None:
            first, last, n = counts["turns"] or (turn, None, 0)
            counts["turns"] = (first, turn, n + (turn != last))
        yield from ((own, "edit", e) for e in repair.add(role, text, fault))
    if repair is not None:
        yield from end()


def batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= most or size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def arrow_id(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def repaired(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: every edit of every conversation in order, as K, R, D or I with the row it makes.

    Conversations have ``conv_id, turn, role, text``; null roles and texts are one space, a null id is a conversation of its
    own, rows of one turn stand in order of role and text. A row's first fault counts: blank, duplicate (role and text seen
    earlier), truncated. Blank and duplicate rows go; keeping a truncated one costs 5. Rows with edit D are those that go.
    """
    kind = dict(conversations.dtypes)["conv_id"]
    schema = pa.schema([("conv_id", arrow_id(kind)), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            place = 0
            for own, what, value in edits_of(batches):
                if what == "end":
                    place = 0
                else:
                    yield own, place, *value
                    place += 1

        yield from batched(rows(), schema)

    return prepared(conversations).mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digests(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``conv_id``, the counts, ``audit`` (the edits' letters) and ``repaired_sha256`` of each conversation, as its edits stream by.

    ids has a column conv_id with all conversations that have a row in the result; those without rows have zeros.
    """
    kind = dict(conversations.dtypes)["conv_id"]
    schema = pa.schema([("conv_id", arrow_id(kind)), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            audit, digest, between = bytearray(), hashlib.sha256(), b""
            for own, what, value in edits_of(batches):
                if what == "end":
                    yield own, *value, audit.decode(), digest.hexdigest()
                    audit, digest, between = bytearray(), hashlib.sha256(), b""
                    continue
                edit, role, text = value
                audit += edit.encode()
                if edit != "D":
                    digest.update(between + f"{role}:{text}".encode())
                    between = b"\n"

        yield from batched(rows(), schema)

    made = prepared(conversations).mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")
    if ids is None:
        return made
    every, found = ids.select("conv_id").distinct(), made.withColumnRenamed("conv_id", "_id")
    rows = every.join(found, every.conv_id.eqNullSafe(found["_id"]), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    return rows.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the damage that crc32 of ``conv_id:turn`` (nulls: one space) by 20 decides.

    0 drops a row, 1 empties its text, 2 takes .!? out of it, 3 repeats it, 4 makes its role user.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(name.cast("binary")) % 20).alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
