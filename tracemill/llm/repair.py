"""Repair of conversations whose turns were lost, cut, repeated or given to the wrong role.

A repaired conversation is a retained subsequence of its turns, kept or reroled,
with empty turns inserted, whose roles read ``system? (user assistant)+`` or
nothing. A dynamic program over the state after the last retained turn (none
yet, system, user, assistant) finds the cheapest: each state holds the running
minimum of its cost less the prefix sum of deletions, so that the gap before the
next retained turn costs nothing to price; the pair of roles across a gap
determines what is inserted into it. Equal costs are settled by the audit, the
string of edits: audits of different states never are prefixes of each other, so
their order is known from the order of the states they came from, without
comparing strings.

Marks of the turns (a few bytes each) are shuffled and read in order first, as a
stream that holds four bytes a turn; texts meet the finished audits in a second
stream that holds one batch. Turns that repeat earlier ones are found by a window
over digests, not in the stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, cycle

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tracemill.llm.staging import released, small_batches, stage

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = (None, "system", "user", "assistant")
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = ("su", "ua", "au")
#: inserted turns between the state before a gap and the one after it; state NONE after it is the end
BETWEEN = {
    (NONE, SYSTEM): (), (NONE, USER): (), (NONE, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,), (USER, ASSISTANT): (),
    (USER, USER): (ASSISTANT,), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
    (NONE, NONE): (), (SYSTEM, NONE): (USER, ASSISTANT), (USER, NONE): (ASSISTANT,), (ASSISTANT, NONE): (),
}
_FROM = {t: [r for r in range(4) if (r, t) in BETWEEN] for t in range(4)}
SPACE = " \t\n\x0b\f\r"
_MOST = (1 << 63) - 1


class Repairer:
    """The edits of one conversation, fed turn by turn."""

    def __init__(self):
        self.cost: list[int | None] = [0, None, None, None]  # of each state, less all deletions so far
        self.order = [0, 0, 0, 0]  # of the states' audits
        self.steps = bytearray()  # for each turn and state: state before * 12 + edit (0: D, 1: K, 2: R) * 4 + insertions
        self.turns = 0

    def feed(self, initial: str, lost: bool, truncated: bool) -> None:
        """The next turn; a ``lost`` one (blank, or seen before) must go."""
        self.turns += 1
        steps = [s * 12 for s in range(4)]
        if not lost:
            own, cost, order = INITIALS.get(initial, NONE), self.cost, self.order
            best = [(c, order[s], "D", s * 12) if c is not None else None for s, c in enumerate(cost)]
            for to in (SYSTEM, USER, ASSISTANT):
                if to == own:
                    price, letter, code = -DELETE, "K", 4
                elif to == SYSTEM:
                    continue
                else:
                    price, letter, code = REROLE - DELETE, "R", 8
                price += TRUNCATED * truncated
                for s in _FROM[to]:
                    if cost[s] is not None:
                        n = len(BETWEEN[s, to])
                        found = (cost[s] + price + INSERT * n, order[s], "I" * n + letter, s * 12 + code + n)
                        if best[to] is None or found < best[to]:
                            best[to] = found
            live = sorted((b[1:3], s) for s, b in enumerate(best) if b is not None)
            for place, (_, s) in enumerate(live):
                self.order[s] = place
            self.cost = [b and b[0] for b in best]
            steps = [b[3] if b else 0 for b in best]
        self.steps += bytes(steps)

    def finish(self) -> tuple[int, str]:
        """The least cost, and the least audit of that cost."""
        ends = [(c + INSERT * len(BETWEEN[s, NONE]), self.order[s], s) for s, c in enumerate(self.cost) if c is not None]
        cost, _, state = min(ends)
        audit = ["I" * len(BETWEEN[state, NONE])]
        for turn in range(self.turns - 1, -1, -1):
            state, edit = divmod(self.steps[4 * turn + state], 12)
            audit.append("I" * (edit % 4) + "DKR"[edit // 4])
        return cost + DELETE * self.turns, "".join(reversed(audit))


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text of the rows, damaged by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes the marks ``.!?`` from it, 3
    repeats it, 4 makes it the user's. Nulls count as one space.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))
    return rows.withColumn("copy", F.explode("copies")).drop("copies", "copy")


def _ordered(turns: DataFrame) -> DataFrame:
    """Nulls as one space, and a digest of each text: turns of one number are ordered by role, then by digest."""
    texts = {c: F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")}
    return turns.select("conv_id", "turn", *(e.alias(c) for c, e in texts.items())).withColumn("digest", F.unhex(F.sha2("text", 256)))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a partition in which they lie one after the other, each after its marker."""
    done: dict[str, list] = {}
    ids: list[pa.Array] = []
    now: dict = {}

    def close() -> None:
        if now:
            cost, audit = now["edits"].finish()
            gaps = now["last"] - now["first"] + 1 - now["numbers"] if now["numbers"] else 0
            for k, v in (("gaps", min(gaps, _MOST)), *((k, now[k]) for k in ("blank", "duplicate", "truncated", "illegal")), ("cost", cost), ("audit", audit)):
                done.setdefault(k, []).append(v)

    def flushed() -> Iterator[pa.RecordBatch]:
        if done:
            n = len(done["cost"])
            columns = {k: pa.array(v, pa.string() if k == "audit" else pa.int64()) for k, v in done.items()}
            done.clear()
            closed, rest = pa.concat_arrays(ids)[:n], pa.concat_arrays(ids)[n:]
            ids[:] = [rest]
            yield pa.RecordBatch.from_arrays([closed, *columns.values()], ["conv_id", *columns])

    for batch in batches:
        marker = batch.column(1)
        ids.append(batch.column(0).filter(marker))
        for begins, turn, initial, blank, duplicate, truncated in zip(marker.to_pylist(), *(batch.column(i).to_pylist() for i in range(2, 7))):
            if begins:
                close()
                now = {"edits": Repairer(), "before": None, "first": None, "last": None, "numbers": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                continue
            if turn is not None and turn != now["last"]:
                now["first"] = turn if now["first"] is None else now["first"]
                now["last"] = turn
                now["numbers"] += 1
            now["illegal"] += now["before"] is not None and now["before"] + initial not in LEGAL
            now["before"] = initial
            fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else None
            if fault:
                now[fault] += 1
            now["edits"].feed(initial, fault in ("blank", "duplicate"), fault == "truncated")
        yield from flushed()
    close()
    yield from flushed()


def find_repairs(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs) and audit of each conversation of ``ids`` (else of ``turns``).

    ``turns`` has conv_id, turn (integers), role, text. Order: by turn, nulls
    first; of one number by role, then by SHA-256 of the text. The first fault of
    a turn counts: blank (white space only), duplicate (role and text seen
    before), truncated (it does not end in ``.!?``). ``gaps`` are missing turn
    numbers, ``illegal`` adjacent roles that do not follow each other. In the
    audit K keeps a turn (free), R gives it to user or assistant (3), D deletes it
    (4; all blank and duplicate ones go), I inserts an empty turn (3); truncated
    turns that stay cost 3 more. Of the cheapest audits the least one counts. A
    turn is kept as what its role's initial says (s, u, a); other roles, empty
    ones too, must be reroled or deleted. Null texts and roles count as one
    space. A null conv_id is one conversation. Ids without turns give zeros and
    an empty audit; an empty table gives no rows. Other columns are ignored. One
    conversation is one stream through one task, four bytes held a turn.
    """
    rows = _ordered(turns)
    ended = F.rtrim(F.col("text"), F.lit(SPACE))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("turn")) > 1
    marks = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "digest", F.substring("role", 1, 1).alias("initial"),
        (ended == "").alias("blank"), (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    ).withColumn("duplicate", again)
    begin = (ids if ids is not None else turns).select("conv_id").distinct()
    both = marks.withColumn("begins", F.lit(False)).unionByName(begin.withColumn("begins", F.lit(True)), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("begins"), "turn", "role", "digest", "duplicate")
    longs = [StructField(c, LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    schema = StructType([begin.schema["conv_id"], *longs, StructField("audit", StringType())])
    return both.select("conv_id", "begins", "turn", "initial", "blank", "duplicate", "truncated").mapInArrow(released(_summaries), schema)


class Mender:
    """Applies the audit of one conversation, turn by turn."""

    def __init__(self, audit: str):
        kept = len(audit) - audit.count("D")
        self.audit, self.at, self.last = audit, 0, len(audit.rstrip("I"))
        self.roles = chain((SYSTEM,) * (kept % 2), cycle((USER, ASSISTANT)))  # only after a system turn an odd number is left

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", ROLES[next(self.roles)], ""

    def feed(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what stands for the next turn: insertions before it, itself unless it goes, those after the last turn."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            new = ROLES[next(self.roles)]
            yield edit, role if edit == "K" else new, text
        if self.at == self.last:
            yield from self._inserted()


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that are left; each conversation's audit comes before its turns."""
    mender, position = Mender(""), 0
    for batch in batches:
        out: list[tuple] = []
        source: list[int] = []
        for i, (audit, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
            if audit is not None:
                mender, position = Mender(audit), 0
                continue
            for turn in mender.feed(role, text):
                out.append((position, *turn))
                source.append(i)
                position += 1
        columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *columns], ["conv_id", "position", "edit", "role", "text"])


def repaired_turns(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, position (from 0), edit (K, R or I), role, text of the turns after the audits that :func:`find_repairs` gave for ``turns``.

    Each conversation lies in order within one partition; texts pass as a stream.
    """
    small_batches(turns.sparkSession)
    rows = _ordered(turns).select("conv_id", F.lit(None).cast("string").alias("audit"), "role", "text", "turn", "digest")
    both = repairs.select("conv_id", "audit").unionByName(rows, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("audit"), "turn", "role", "digest")
    schema = StructType([repairs.schema["conv_id"], StructField("position", LongType()), *(StructField(c, StringType()) for c in ("edit", "role", "text"))])
    return both.select("conv_id", "audit", "role", "text").mapInArrow(released(_mended), schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begun: list[pa.Array] = []
    digests: list[str] = []
    state = None
    for batch in batches:
        first = pc.equal(batch.column(1), 0)
        begun.append(batch.column(0).filter(first))
        for begins, role, text in zip(first.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if begins:
                if state:
                    digests.append(state.hexdigest())
                state = hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if digests:
            ids = pa.concat_arrays(begun)
            yield pa.RecordBatch.from_arrays([ids[: len(digests)], pa.array(digests)], ["conv_id", "repaired_sha256"])
            begun, digests = [ids[len(digests) :]], []
    if state:
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(begun), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])


def turns_sha256(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of what :func:`repaired_turns` gave: lines ``role:text``, hashed as they pass; conversations without turns are absent."""
    schema = StructType([repaired.schema["conv_id"], StructField("repaired_sha256", StringType())])
    return repaired.select("conv_id", "position", "role", "text").mapInArrow(released(_digests), schema)


def repair_conversations(turns: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What :func:`find_repairs` and :func:`repaired_turns` give; the audits are staged, as both need them."""
    repairs = stage(find_repairs(turns, ids), "repairs")
    return repairs, repaired_turns(turns, repairs)
