"""Cheapest edits that give conversations a proper order of roles, by a lazily determinised weighted automaton.

Roles shall read (s?(ua)+)? by their initials. A small automaton with costs (keep, rerole, delete, insert) accepts what
edits can make of a turn; the vector of what each of its states still costs to the end, less its minimum, is a state of
the deterministic automaton. There are few of these; each is made when first met, and its arc for a symbol is kept in a
table, so one scan from the last turn to the first is a table lookup a turn. Going back over the scan, from the first
turn on, the least letter whose arc is tight is taken: any tight arc leads to a cheapest end, so this is the
ASCII-least cheapest audit.

Turns are numbered by ranges, and a conversation is packed into blocks of BLOCK turns, a character each. A
conversation of several blocks is scanned block by block from all four ends at once: what a block costs from state to
state is a matrix, the matrices of a conversation are folded from its end, and then each block is traced from all four
states with its true end known. So only blocks, matrices and the audit are ever held. The hash of a repaired
conversation is taken as its turns pass in order; SHA-256 can't be split, so one task streams them, holding none.
"""

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import saved, short_batches
from folioscope.llm.numbering import divided, numbered

BLOCK = 1 << 15
REROLE, DELETE, INSERT, REPHRASE = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: States: nothing yet, after the system's turn, after a user's, after an assistant's; nothing and the last accept.
STATES, FINAL, NEVER = 4, (0, 3), 1 << 40
#: What a state must see next when a role is given to a turn, and where it then is.
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
#: A symbol is a letter: 4 * fault + initial. Blank and duplicate turns must go.
FAULTS, INITIALS = ("", "blank", "duplicate", "truncated"), "sua"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
SPACE = r"\x20\x09-\x0D"


def symbol(fault: int, initial: int) -> str:
    return chr(97 + 4 * fault + initial)


class Automaton:
    """The deterministic automaton of costs to the end, read from the last turn to the first, as far as it was met."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, str], tuple[int, int]] = {}
        self.traces: dict[tuple[int, str, int], tuple[str, int]] = {}

    def state(self, costs: Iterable[int]) -> tuple[int, int]:
        """The number of the normalised vector, closed under insertions, and what was taken off."""
        b = list(costs)
        two = min(b[2], INSERT + b[3])
        closed = [min(b[0], INSERT + two), min(b[1], INSERT + two), two, min(b[3], INSERT + b[2])]
        least = min(closed)
        vector = tuple(min(c - least, NEVER) if c < NEVER else NEVER for c in closed)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    def end(self) -> tuple[int, int]:
        return self.state(0 if q in FINAL else NEVER for q in range(STATES))

    @staticmethod
    def arcs(q: int, sign: str) -> Iterator[tuple[str, int, int]]:
        """Edits of a turn in state q, least letter first (A and U rerole): the edit, its cost, the state after it."""
        fault, initial = divmod(ord(sign) - 97, 4)
        yield "D", DELETE, q
        if FAULTS[fault] not in ("blank", "duplicate"):
            worse = REPHRASE if FAULTS[fault] == "truncated" else 0
            role, after = NEXT[q]
            if INITIALS[initial : initial + 1] == role:
                yield "K", worse, after
            elif INITIALS[initial : initial + 1] == "s" and q == 0:
                yield "K", worse, 1
            yield role.upper(), REROLE + worse, after

    def before(self, after: int, sign: str) -> tuple[int, int]:
        """The state before a turn, from the state after it, and the cost that this takes off: looked up, or made once."""
        got = self.table.get((after, sign))
        if got is None:
            costs = self.vectors[after]
            got = self.table[after, sign] = self.state(min(cost + costs[to] for _, cost, to in self.arcs(q, sign)) for q in range(STATES))
        return got

    def scanned(self, signs: str, end: int) -> tuple[list[int], int]:
        """The states before each turn and at the end, and the costs taken off on the way."""
        states, total = [end] * (len(signs) + 1), 0
        for i in range(len(signs) - 1, -1, -1):
            states[i], off = self.before(states[i + 1], signs[i])
            total += off
        return states, total

    def step(self, after: int, sign: str, q: int) -> tuple[str, int]:
        """The least tight edits at a turn: inserted roles, then what is done with the turn; and the state after it."""
        key = (after, sign, q)
        if key not in self.traces:
            (here, off), edits = self.before(after, sign), ""
            while True:
                left = self.vectors[here][q] + off
                tight = [(e, to) for e, cost, to in self.arcs(q, sign) if cost + self.vectors[after][to] == left]
                role, to = NEXT[q]
                if (not tight or tight[0][0] != "D") and INSERT + self.vectors[here][to] + off == left:
                    edits, q = edits + role, to
                    continue
                self.traces[key] = edits + tight[0][0], tight[0][1]
                break
        return self.traces[key]

    def traced(self, signs: str, states: list[int], q: int) -> tuple[str, int]:
        """The edits from state q, and the state after the last turn. Where q can't reach the end, no edits."""
        if self.vectors[states[0]][q] >= NEVER:
            return "", q
        out = []
        for i, sign in enumerate(signs):
            edits, q = self.step(states[i + 1], sign, q)
            out.append(edits)
        return "".join(out), q

    def tail(self, q: int) -> str:
        """The roles inserted after the last turn."""
        return "".join(NEXT[p][0] for p in ({1: (1, 2), 2: (2,)}.get(q, ())))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults by crc32(conv_id:turn) % 20 (a null is one space): 0 drops one, 1 empties it, 2 takes its end marks, 3 repeats it, 4 makes it the user's."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.crc32(key.cast("binary")) % 20
    text, role = (F.coalesce(c, F.lit(" ")) for c in ("text", "role"))
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    kept = turns.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"), text.alias("text"), fate.alias("_fate")).where("_fate <> 0")
    return kept.withColumn("_twice", F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_fate", "_twice")


def _name(conv_id: str = "conv_id") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("-"))


def _ordered(turns: DataFrame) -> DataFrame:
    text, role = (F.coalesce(c, F.lit(" ")) for c in ("text", "role"))
    same = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = turns.select(_name().alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), same.alias("same"))
    return numbered(rows, "conv", ["turn", "same"])


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """conv, block, size (turns of the conversation), signs (a letter for each turn, in order)."""
    repeated = rows.groupBy("conv", "same").agg(F.min("idx").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    spoken = F.col("text").rlike(f"[^{SPACE}]")
    ended = F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    initial = F.substring("role", 1, 1)
    slim = rows.select("conv", "same", "idx", "size", (~spoken).alias("blank"), ended.alias("ended"), F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS)), initial), F.lit(0)).alias("at"))
    fault = F.when(F.col("blank"), 1).when(F.col("idx") > F.col("first"), 2).when(~F.col("ended"), 3).otherwise(0)
    code = 97 + 4 * fault + F.when(F.col("at") > 0, F.col("at") - 1).otherwise(len(INITIALS))
    signed = slim.join(repeated, ["conv", "same"], "left").select("conv", divided("idx", block).alias("block"), "idx", "size", F.char(code).alias("sign"))
    signs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sign"))), lambda c: c["sign"]), "")
    return signed.groupBy("conv", "block").agg(F.min("size").alias("size"), signs.alias("signs"))


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """A batch of rows by a schema of plain names and types."""
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _in_arrow(work: Callable[[Automaton, dict], Iterator[tuple]], schema: str) -> Callable[[DataFrame], DataFrame]:
    """Rows by rows, with one automaton for each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            yield _rows([out for row in batch.to_pylist() for out in work(automaton, row)], schema)

    return lambda df: short_batches(df).mapInArrow(run, schema)


def _counts(signs: str) -> tuple[int, ...]:
    """Blank, duplicate, truncated turns, and neighbours whose initials don't follow each other."""
    faults = [sum(signs.count(symbol(f, i)) for i in range(4)) for f in range(1, 4)]
    initials = [INITIALS[k : k + 1] for k in ((ord(s) - 97) % 4 for s in signs)]
    return (*faults, sum(pair not in LEGAL for pair in zip(initials, initials[1:])))


def _alone(automaton: Automaton, row: dict) -> Iterator[tuple]:
    """A conversation of one block."""
    end, base = automaton.end()
    states, total = automaton.scanned(row["signs"], end)
    edits, q = automaton.traced(row["signs"], states, 0)
    yield row["conv"], row["block"], edits + automaton.tail(q), total + base + automaton.vectors[states[0]][0], *_counts(row["signs"])


def _matrix(automaton: Automaton, row: dict) -> Iterator[tuple]:
    """What a block costs from each state (within) to each one at its end."""
    costs = []
    for goal in range(STATES):
        end, base = automaton.state(0 if q == goal else NEVER for q in range(STATES))
        states, total = automaton.scanned(row["signs"], end)
        costs += [min(NEVER, base + total + c) if c < NEVER else NEVER for c in automaton.vectors[states[0]]]
    yield row["conv"], row["block"], costs


def _ends(automaton: Automaton, row: dict) -> Iterator[tuple]:
    """The costs at the end of each block, and, with the first block, of the whole conversation."""
    end, base = automaton.end()
    costs = [base + c for c in automaton.vectors[end]]
    for block in reversed(row["blocks"]):
        after, matrix = costs, block["costs"]
        costs = [min(min(matrix[STATES * goal + q] + after[goal] for goal in range(STATES)), NEVER) for q in range(STATES)]
        yield row["conv"], block["block"], after, costs[0]


def _ways(automaton: Automaton, row: dict) -> Iterator[tuple]:
    """A block's edits from each state, with the costs at its end known."""
    end, _ = automaton.state(row["costs"])
    states, _ = automaton.scanned(row["signs"], end)
    ways = [automaton.traced(row["signs"], states, q) for q in range(STATES)]
    yield row["conv"], row["block"], row["cost"] if row["block"] == 0 else 0, [w for w, _ in ways], [q for _, q in ways], *_counts(row["signs"])


def _entries(automaton: Automaton, row: dict) -> Iterator[tuple]:
    """The state in which each block is entered; after the last one, what is inserted at the end."""
    q = 0
    for i, block in enumerate(row["blocks"]):
        entry, q = q, block["exits"][q]
        yield row["conv"], block["block"], entry, automaton.tail(q) if i + 1 == len(row["blocks"]) else ""


FOUND = "conv string, block long, edits string, cost long, blank long, duplicate long, truncated long, illegal long"


def _edited(blocks: DataFrame, block: int) -> DataFrame:
    """FOUND: each block's edits and counts; the first block has the cost."""
    found = _in_arrow(_alone, FOUND)(blocks.where(F.col("size") <= block))
    if not blocks.where(F.col("size") > block).limit(1).count():
        return found
    parts = blocks.where(F.col("size") > block)

    def by_conversation(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", *columns))).alias("blocks"))

    matrices = _in_arrow(_matrix, "conv string, block long, costs array<long>")(parts)
    ends = _in_arrow(_ends, "conv string, block long, costs array<long>, cost long")(by_conversation(matrices, "costs"))
    ways = saved(_in_arrow(_ways, "conv string, block long, cost long, ways array<string>, exits array<int>, blank long, duplicate long, truncated long, illegal long")(parts.join(ends, ["conv", "block"])))
    entries = _in_arrow(_entries, "conv string, block long, entry int, edits string")(by_conversation(ways, "exits"))
    # Where two blocks meet, their neighbouring turns count as well.
    last, first = F.ascii(F.substring("signs", -1, 1)), F.ascii(F.substring("signs", 1, 1))
    left = parts.select("conv", (F.col("block") + 1).alias("block"), ((last - 97) % 4).alias("last"))
    pair = F.concat_ws("", *[F.element_at(F.array(*map(F.lit, INITIALS + "?")), F.col(c) + 1) for c in ("last", "first")])
    met = parts.select("conv", "block", ((first - 97) % 4).alias("first")).join(left, ["conv", "block"]).select("conv", "block", (~pair.isin(["".join(p) for p in LEGAL])).cast("long").alias("met"))
    whole = ways.join(entries, ["conv", "block"]).join(met, ["conv", "block"], "left")
    return found.union(
        whole.select("conv", "block", F.concat(F.element_at("ways", F.col("entry") + 1), "edits").alias("edits"), "cost", "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("met", F.lit(0))).alias("illegal"))
    )


LINES = "conv string, audit string, repaired_sha256 string"


def _rebuilt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks' edits and turns in order, to each conversation's audit and hash; texts pass through."""
    conv, audit, digest, began, edits, at = None, [], hashlib.sha256(), False, "", 0

    def line(role: str, text: str) -> None:
        nonlocal began
        digest.update((f"\n{role}:" if began else f"{role}:").encode())
        digest.update(text.encode())
        began = True

    def inserted() -> None:
        nonlocal at
        while at < len(edits) and edits[at].islower():
            line(ROLES[edits[at]], "")
            at += 1

    def result() -> list[tuple]:
        return [] if conv is None else [(conv, "".join(audit), digest.hexdigest())]

    for batch in batches:
        done = []
        for name, own, role, text in zip(*(batch[k].to_pylist() for k in ("conv", "edits", "role", "text"))):
            if name != conv or own is not None:
                inserted()
            if name != conv:
                done += result()
                conv, audit, digest, began, edits, at = name, [], hashlib.sha256(), False, "", 0
            if own is not None:
                edits, at = own, 0
                audit.append("".join("I" if e.islower() else "R" if e in "UA" else e for e in own))
                continue
            inserted()
            edit, at = edits[at], at + 1
            if edit != "D":
                line(role if edit == "K" else ROLES[edit.lower()], text)
        yield _rows(done, LINES)
    inserted()
    yield _rows(result(), LINES)


def repaired(turns: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """A row per conv_id, of conversations where given: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    turns: conv_id, turn, role, text. A conversation's turns go by turn, null ones first; those that share a turn go by
    a hash of role and text, so repeated rows are neighbours and all but one are duplicates. Null roles and texts are
    one space; a null conv_id is a conversation. Roles other than those that begin with s, u or a can't be kept. A very
    long text only passes through. Conversations without turns have zeros, an empty audit and the hash of nothing; an
    empty table gives no rows. Other columns aren't read.
    """
    rows = _ordered(turns)
    found = saved(_edited(saved(_blocks(rows, block)), block))
    packs = found.select("conv", (F.col("block") * block).alias("idx"), F.lit(0).alias("kind"), "edits", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    lines = rows.select("conv", "idx", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("edits"), "role", "text")
    streamed = short_batches(packs.union(lines)).repartition("conv").sortWithinPartitions("conv", "idx", "kind").mapInArrow(_rebuilt, LINES)
    sums = found.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("cost", "blank", "duplicate", "truncated", "illegal")])
    spans = rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    named = (turns if conversations is None else conversations).select("conv_id").distinct().withColumn("conv", _name())
    whole = named.join(sums, "conv", "left").join(spans, "conv", "left").join(streamed, "conv", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
