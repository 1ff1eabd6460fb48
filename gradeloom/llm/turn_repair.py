"""Repair of conversation structure by aligning turns to an alternating grammar.

A well-formed conversation is empty or reads, by the initials of its roles,
`s?(ua)+`. There is one such string of each feasible length, so a repair is a
Wagner-Fischer alignment of the turns with the string of some length. Keeping
a turn costs 0, a new role (user or assistant) 1, deleting 2, inserting an
empty turn 5; a blank or repeated turn must be deleted, and a truncated one
that stays adds 5. The cheapest edits win; of equally cheap ones, the audit
(the edits' initials in order) that is least in ASCII.

All strings of even length are endings of one another, and so are the odd ones
behind their first letter, so one table, filled from the last turn on, holds
the costs of every length. It's cut to Ukkonen bands: a cell that only
alignments dearer than the incumbent could pass (a greedy repair) isn't filled.
Every length of least cost is traced back and their audits are compared. Rows
of the table are kept at intervals and made again for tracing, so that a long
conversation takes memory of about (its turns)**0.5 x band cells, besides a
byte a turn.

`report` and `repair` stream the turns of a partition, sorted by Spark, which
spills: no conversation is gathered, but one conversation is read by one task.
Turns cross the network without their texts but for the one shuffle in which
`repair` reads them. `faults` finds repeated turns by a window per
(conversation, role, digest of text).

Defined cases: a null role or text is one space; null conversation ids are one
conversation; null turns come first and count in no gap; turns with one number
are ordered by role and SHA-256 of the text; a conversation without turns has
zeros and an empty audit; an empty table gives an empty table. Other columns
aren't read, so they may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.llm.common import SPACE_CLASS, WORD_PATTERN, slices

DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5
SYSTEM, USER, ASSISTANT, ELSE = range(4)
FINE, BLANK, REPEATED, TRUNCATED = range(4)
NEVER = 1 << 40
#: cells of a table that is kept whole; a larger one keeps rows at intervals
WHOLE_CELLS = 1 << 20
#: short conversations with one pattern of roles and faults have one alignment; so many patterns are remembered
REMEMBERED = 20_000
ROLES = {"u": "user", "a": "assistant"}


class Alignment:
    """The cheapest edits of one conversation, given as a byte a turn: 4 x initial + fault."""

    def __init__(self, turns: bytes, whole_cells: int = WHOLE_CELLS):
        self.initial = np.frombuffer(turns, np.uint8) >> 2
        self.fault = np.frombuffer(turns, np.uint8) & 3
        self.n = len(turns)
        self.forced = (self.fault == BLANK) | (self.fault == REPEATED)
        spare = self._greedy() - DELETE * int(self.forced.sum())
        self.down = spare // DELETE
        self.width = self.down + spare // INSERT + 1
        #: turns from r on that may stay; the band at r is centred there
        self.left = np.concatenate([np.cumsum(~self.forced[::-1])[::-1], [0]])
        self.step = self.n + 1 if (self.n + 1) * self.width <= whole_cells else max(1, int(self.n ** 0.5))
        self.rows = {self.n: self._last()}
        self._fill(0, self.n, lambda r: r % self.step == 0)

    def _greedy(self) -> int:
        """Cost of keeping each turn that fits and deleting the rest."""
        cost, last, kept = 0, None, []
        for i in range(self.n):
            fits = not self.forced[i] and (self.initial[i] == (USER if last in (None, SYSTEM, ASSISTANT) else ASSISTANT) or (last is None and self.initial[i] == SYSTEM))
            if fits:
                last = self.initial[i]
                kept.append(i)
            else:
                cost += DELETE
        while kept and last != ASSISTANT:
            i = kept.pop()
            last = self.initial[kept[-1]] if kept else None
            cost += DELETE
        return cost + sum(CUT_OFF for i in kept if self.fault[i] == TRUNCATED)

    def _sizes(self, r: int) -> np.ndarray:
        """The lengths that remain to be matched in the band at turn r."""
        return self.left[r] - self.down + np.arange(self.width)

    def _last(self) -> tuple[np.ndarray, np.ndarray]:
        sizes = self._sizes(self.n)
        return np.where(sizes >= 0, INSERT * sizes, NEVER), np.full(self.width, NEVER)

    def _before(self, r: int, after: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Row r of the table from row r + 1: costs where the rest alternates, and where a system turn comes first."""
        plain, first = after
        if self.forced[r]:
            return plain + DELETE, first + DELETE
        sizes, steps = self._sizes(r), INSERT * np.arange(self.width)
        cut = CUT_OFF if self.fault[r] == TRUNCATED else 0
        wanted = np.where(sizes % 2 == 0, USER, ASSISTANT)
        keep = plain + np.where(wanted == self.initial[r], 0, REROLE) + cut
        drop = np.append(plain[1:], NEVER) + DELETE
        made = np.where(sizes >= 0, np.minimum(np.where(sizes >= 1, keep, NEVER), drop), NEVER)
        made = np.where(sizes >= 0, np.minimum.accumulate(np.where(sizes >= 0, made - steps, NEVER)) + steps, NEVER)
        begin = np.append(first[1:], NEVER) + DELETE
        if self.initial[r] == SYSTEM:
            begin = np.minimum(begin, np.where((sizes >= 3) & (sizes % 2 == 1), plain + cut, NEVER))
        return made, begin

    def _fill(self, begin: int, end: int, keep: Callable[[int], bool]) -> None:
        row = self.rows[end]
        for r in range(end - 1, begin - 1, -1):
            row = self._before(r, row)
            if keep(r):
                self.rows[r] = row

    def best(self) -> tuple[int, str]:
        """(cost, audit)."""
        sizes, (plain, first) = self._sizes(0), self.rows[0]
        costs = np.where(sizes % 2 == 0, plain, first)
        cost = int(costs.min())
        paths = [(bool(m % 2), int(m), bytearray()) for m in sizes[costs == cost]]
        for begin in range(0, self.n + 1, self.step):
            end = min(begin + self.step, self.n)
            if end > begin + 1:
                self._fill(begin, end, lambda r: True)
            paths = [self._trace(path, begin, end) for path in paths]
            for r in range(begin, end):
                if r % self.step:
                    del self.rows[r]
        return cost, min(bytes(audit) for _, _, audit in paths).decode()

    def _cost(self, r: int, m: int, system: bool) -> int:
        at = m - self.left[r] + self.down
        return int(self.rows[r][system][at]) if 0 <= at < self.width else NEVER

    def _trace(self, path: tuple[bool, int, bytearray], r: int, end: int) -> tuple[bool, int, bytearray]:
        """Go on from turn r to turn `end` (past the last one: to the end of the string), the least letter first."""
        system, m, audit = path
        while r < end or end == self.n and m:
            now = self._cost(r, m, system)
            if r < self.n and now == DELETE + self._cost(r + 1, m, system):
                r += 1
                audit += b"D"
                continue
            if not system and now == INSERT + self._cost(r, m - 1, False):
                audit += b"I"
            else:
                same = system or self.initial[r] == (USER if m % 2 == 0 else ASSISTANT)
                r += 1
                audit += b"K" if same else b"R"
                system = False
            m -= 1
        return system, m, audit


def align(turns: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of turns given as bytes 4 x initial + fault."""
    return Alignment(turns).best() if turns else (0, "")


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: rows spoilt by crc32(`conv_id:turn`) % 20; dropped ones are marked."""
    kind = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(copies).alias("copy")).drop("copy")


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, dropped and code (4 x initial + fault) of every turn, without its text."""
    text, initial = F.col("text"), F.substring("role", 1, 1)
    blank, ended = ~text.rlike(WORD_PATTERN), text.rlike(rf"[.!?][{SPACE_CLASS}]*\z")
    narrow = turns.select("conv_id", "turn", "role", "dropped", F.sha2(text.cast("binary"), 256).alias("digest"), blank.alias("blank"), ended.alias("ended"),
                          F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(ELSE).alias("initial"))
    same = Window.partitionBy("conv_id", "role", "digest", "dropped").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(F.col("blank"), BLANK).when(F.row_number().over(same) > 1, REPEATED).when(~F.col("ended"), TRUNCATED).otherwise(FINE)
    return narrow.select("conv_id", "turn", "role", "digest", "dropped", (4 * F.col("initial") + fault).cast("int").alias("code"))


REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _finish(conv, turns: bytearray, seen: list, remembered: dict) -> tuple:
    codes = np.frombuffer(bytes(turns), np.uint8)
    fault, initial = codes & 3, (codes >> 2).astype(int)
    pairs = initial[:-1] * 4 + initial[1:]
    legal = np.isin(pairs, [SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER])
    key = bytes(turns)
    found = remembered.get(key)
    if found is None:
        found = align(key)
        if len(key) <= 64:
            if len(remembered) >= REMEMBERED:
                remembered.clear()
            remembered[key] = found
    first, last, different = seen
    gaps = last - first + 1 - different if different else 0
    return conv, gaps, int((fault == BLANK).sum()), int((fault == REPEATED).sum()), int((fault == TRUNCATED).sum()), int((~legal).sum()), *found


def report(turns: DataFrame) -> DataFrame:
    """One row per conversation: its faults, and cost and audit of the cheapest repair."""
    names = [part.split()[0] for part in REPORT.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, codes, seen, done, remembered = None, None, [0, 0, 0], [], {}
        types = [pa.int64()] * (len(names) - 1) + [pa.string()]

        def out():
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*done), types)], names)

        for batch in batches:
            for own, turn, dropped, code in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "dropped", "code"))):
                if codes is None or own != conv:
                    if codes is not None:
                        done.append(_finish(conv, codes, seen, remembered))
                    conv, codes, seen = own, bytearray(), [0, 0, 0]
                if dropped:
                    continue
                codes.append(code)
                if turn is not None and (not seen[2] or turn != seen[1]):
                    seen = [seen[0] if seen[2] else turn, turn, seen[2] + 1]
            if len(done) > 10_000:
                yield out()
                done = []
        if codes is not None:
            done.append(_finish(conv, codes, seen, remembered))
        if done:
            yield out()

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "code"]
    # a repeat of a turn has a larger code than the turn itself, unless both are blank
    return faults(turns).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, REPORT)


def _repaired(audit: str) -> Iterator[str | None]:
    """For each edit: the role it gives (None: the turn's own)."""
    size = len(audit) - audit.count("D")
    place = -(size % 2)
    for letter in audit:
        if letter != "D":
            yield None if letter == "K" else "ua"[place % 2]
            place += 1
        else:
            yield None


def repair(turns: DataFrame) -> DataFrame:
    """`report` with repaired_sha256: the SHA-256 of the repaired turns as lines `role:text`."""
    found = report(turns)
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (part.split() for part in REPORT.split(", ")[1:])]
    texts = turns.where(~F.col("dropped")).select("conv_id", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text", F.struct(*nothing).alias("found"))
    whole = F.struct(*[F.col(part.split()[0]) for part in REPORT.split(", ")[1:]])
    heads = found.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit(None).cast("string").alias("text"), whole.alias("found"))
    both = heads.unionByName(texts).withColumn("body", F.col("text").isNotNull())
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "body", F.col("turn").asc_nulls_first(), "role", "digest")
    names = [part.split()[0] for part in REPORT.split(", ")] + ["repaired_sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, at, roles, started, done = None, None, 0, None, False, []
        types = [pa.int64()] * (len(names) - 2) + [pa.string()] * 2

        def line(role: str, text: str) -> None:
            nonlocal started
            digest.update(("\n" if started else "").encode() + f"{role}:{text}".encode())
            started = True

        def inserted() -> None:
            nonlocal at
            while at < len(head["audit"]) and head["audit"][at] == "I":
                line(ROLES[next(roles)], "")
                at += 1

        def close() -> None:
            inserted()
            done.append((*head.values(), digest.hexdigest()))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*done), types)], names)

        for batch in slices(batches, "text"):
            for conv, body, role, text, found in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "body", "role", "text", "found"))):
                if not body:
                    if head is not None:
                        close()
                    head, digest, at, started = {"conv_id": conv} | found, hashlib.sha256(), 0, False
                    roles = _repaired(head["audit"])
                    continue
                inserted()
                new = next(roles)
                if head["audit"][at] != "D":
                    line(ROLES[new] if new else role, text)
                at += 1
            if len(done) > 10_000:
                yield out()
                done = []
        if head is not None:
            close()
        if done:
            yield out()

    return ordered.mapInArrow(run, REPORT + ", repaired_sha256 string")
