"""Repair of conversation structure by depth-first branch and bound.

A conversation's rows are reduced to one letter each and cut into chunks. For
every state that a chunk may be entered in and every state that it may be left in,
a search over keeping, changing, deleting and inserting rows proves the cheapest
edits; the chunks' answers are then joined in order. A chunk bounds the work of
one search, so a conversation of any length is searched in many tasks; only its
rows' final hash, which depends on all before, follows them one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.llm.common import cut, table
from lumivox.llm.ordered import numbered

#: Rows of one conversation that one search covers.
CHUNK = 64
#: Kinds of damage by remainder, costs of edits, and what truncated rows add if they stay.
KINDS, DROP, EMPTY, UNSTOP, REPEAT, TO_USER = 20, 0, 1, 2, 3, 4
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
STOPS = ".!?"
#: States by the role that came last: none yet, system, user, assistant. A repaired conversation ends in the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = (START, SYSTEM, USER, ASSISTANT), (START, ASSISTANT)
#: Role that an inserted or changed row gets in each state.
NEEDED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: States that a row kept as it is leads to, by state and initial.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
RIGHT_PAIRS = {"su", "ua", "au"}
FAULTS = {"b": "blank", "d": "duplicate", "t": "truncated"}
STATISTICS = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, repaired_sha256 string"

Answer = tuple[int, str]


def least_costs(rows: str) -> list[int]:
    """For every place the least that the rows from there on cost, whatever the states: a lower bound."""
    bound = [0]
    for initial, fault in zip(rows[-2::-2], rows[::-2]):
        bound.append(bound[-1] + (DELETE if fault in "bdt" else 0 if initial in "sua" else REROLE))
    return bound[::-1]


def search(rows: str, entry: int, goal: int, bound: list[int]) -> Answer | None:
    """Cheapest edits, and of these the least as text, that lead from ``entry`` over all rows to ``goal``.

    ``rows`` has two letters a row: the role's initial and the fault. Prefixes wait on
    a stack and the cheapest edit is followed first. A prefix goes if its cost and the
    least cost of what is left exceed the incumbent's (or equal it, and its edits come
    later), or if another prefix came to the same node with a better (cost, edits): of
    two at one node one's edits could begin the other's only by fewer insertions, at less cost.
    """
    n = len(rows) // 2
    best: Answer | None = None
    seen: dict[tuple[int, int], Answer] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, edits = stack.pop()
        known = seen.get((at, state))
        if known is not None and known <= (cost, edits):
            continue
        if best is not None and (cost + bound[at] > best[0] or cost + bound[at] == best[0] and edits > best[1][: len(edits)]):
            continue
        seen[at, state] = cost, edits
        if at == n and state == goal:
            best = cost, edits
            continue
        moves = [(cost + INSERT, at, NEEDED[state], edits + "I")]
        if at < n:
            initial, fault = rows[2 * at], rows[2 * at + 1]
            moves.append((cost + DELETE, at + 1, state, edits + "D"))
            if fault not in "bd":
                stay = cost + (CUT_OFF if fault == "t" else 0)
                kept = KEPT.get((state, initial))
                if kept is not None:
                    moves.append((stay, at + 1, kept, edits + "K"))
                if kept != NEEDED[state]:
                    moves.append((stay + REROLE, at + 1, NEEDED[state], edits + "R"))
        moves.sort(key=lambda m: (m[0] + bound[m[1]], m[3]), reverse=True)
        stack.extend((to, then, price, done) for price, to, then, done in moves)
    return best


@lru_cache(1 << 15)
def answers(rows: str, first: bool, last: bool) -> tuple[tuple[int, int, int, str], ...]:
    """(entry, exit, cost, edits) of every pair of states that a chunk's rows can join."""
    bound = least_costs(rows)
    found = ((a, b, search(rows, a, b, bound)) for a in ((START,) if first else STATES) for b in (ENDS if last else STATES))
    return tuple((a, b, *x) for a, b, x in found if x is not None)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text): rows after damage by the checksum of conversation and turn; missing values are one space."""
    kinds = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    conv, turn, role, text = (conversations[c].cast(kinds[c]) for c in kinds)
    blank = F.lit(" ")
    mark = F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))
    role, text = F.coalesce(role, blank), F.coalesce(text, blank)
    rows = conversations.select(conv.alias("conv"), turn.alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(mark.cast("binary")) % KINDS).alias("kind"))
    kind = F.col("kind")
    rows = rows.where(kind != DROP).select(
        "conv", "turn", F.when(kind == TO_USER, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == EMPTY, "").when(kind == UNSTOP, F.translate("text", STOPS, "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(kind == REPEAT, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def trimmed(text: Column) -> Column:
    """The text without the spaces at its end."""
    return F.rtrim(text, F.lit(SPACES))


def faulty(rows: DataFrame) -> DataFrame:
    """Numbered rows with ``letters``: the role's initial (or ``-``) and the first fault, b, d, t or a dash."""
    same = ["key", "role", "digest"]
    firsts = rows.groupBy(*same).agg(F.min("at").alias("first"))
    end = trimmed(F.col("text"))
    fault = F.when(end == "", "b").when(F.col("at") > F.col("first"), "d").when(~F.substring(end, -1, 1).isin(*STOPS), "t").otherwise("-")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    return rows.join(firsts, same).withColumn("letters", F.concat(initial, fault)).drop("digest", "first")


def chunk_answers(rows: DataFrame, most: int) -> DataFrame:
    """(key, chunk, last, size, answers) of every chunk of every conversation; rows come in order, so a task holds one chunk at a time."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a few bytes a row are much work, so Spark must not put them together
    ordered = rows.select("key", "chunk", "at", "n", "letters").repartition(parts, "key", "chunk").sortWithinPartitions("key", "chunk", "at")
    schema = "key string, chunk long, last boolean, size int, answers array<struct<entry int, exit int, cost long, edits string>>"

    def solved(key: str, chunk: int, n: int, letters: list[str]) -> tuple:
        last = (chunk + 1) * most >= n
        return key, chunk, last, len(letters), [dict(zip(("entry", "exit", "cost", "edits"), x)) for x in answers("".join(letters), chunk == 0, last)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out = []
            for key, chunk, n, letters in zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "n", "letters"))):
                if now != (key, chunk, n):
                    if held:
                        out.append(solved(*now, held))
                    now, held = (key, chunk, n), []
                held.append(letters)
            yield answer_batch(out)
        if held:
            yield answer_batch([solved(*now, held)])

    kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))

    def answer_batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * 5
        types = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), kind]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "chunk", "last", "size", "answers"])

    return ordered.mapInArrow(run, schema)


def pieces_of(edits: str, sizes: list[int]) -> list[str]:
    """The edits of each chunk: insertions belong to the row after them, those at the end to the last chunk."""
    out, at = [], 0
    for size in sizes[:-1]:
        start = at
        while size:
            size -= edits[at] != "I"
            at += 1
        out.append(edits[start:at])
    return [*out, edits[at:]]


def plans(solved: DataFrame) -> DataFrame:
    """(key, chunk, edits, cost, audit): each chunk's edits of the whole conversation's best; cost and audit beside the first.

    Chunks come in order. Per state only the best (cost, edits) so far is kept, so a task
    holds four audits of one conversation, whose own length they have.
    """
    ordered = solved.repartition("key").sortWithinPartitions("key", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, sizes = {START: (0, "")}, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                after: dict[int, Answer] = {}
                for x in row["answers"]:
                    if x["entry"] in best:
                        cost, edits = best[x["entry"]]
                        found = cost + x["cost"], edits + x["edits"]
                        if x["exit"] not in after or found < after[x["exit"]]:
                            after[x["exit"]] = found
                best = after
                sizes.append(row["size"])
                if row["last"]:
                    cost, audit = min(best[e] for e in ENDS if e in best)
                    out += [(row["key"], i, piece, None if i else cost, None if i else audit) for i, piece in enumerate(pieces_of(audit, sizes))]
                    best, sizes = {START: (0, "")}, []
            columns = list(zip(*out)) if out else [()] * 5
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "chunk", "edits", "cost", "audit"])

    return ordered.mapInArrow(run, "key string, chunk long, edits string, cost long, audit string")


class Summary:
    """What one conversation's rows, taken in order, add up to."""

    def __init__(self, conv: int | None):
        self.conv, self.faults, self.illegal = conv, dict.fromkeys(FAULTS, 0), 0
        self.first = self.last = self.role = None
        self.turns = self.kept = 0
        self.state, self.hash, self.chunk, self.edits = START, hashlib.sha256(), None, iter("")

    def put(self, role: str, text: str, state: int) -> None:
        self.hash.update((b"\n" if self.kept else b"") + f"{role}:{text}".encode())
        self.kept, self.state = self.kept + 1, state

    def insert(self) -> None:
        state = NEEDED[self.state]
        self.put(NAMES[state], "", state)

    def add(self, turn: int | None, role: str, text: str, letters: str, chunk: int, edits: str) -> None:
        if letters[1] in self.faults:
            self.faults[letters[1]] += 1
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.role is not None and self.role + letters[0] not in RIGHT_PAIRS:
            self.illegal += 1
        self.role = letters[0]
        if chunk != self.chunk:
            self.chunk, self.edits = chunk, iter(edits)
        while (edit := next(self.edits)) == "I":
            self.insert()
        if edit == "K":
            self.put(role, text, KEPT[self.state, letters[0]])
        elif edit == "R":
            self.put(NAMES[NEEDED[self.state]], text, NEEDED[self.state])

    def row(self) -> tuple:
        for _ in self.edits:  # what is left are insertions at the end
            self.insert()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults.values(), self.illegal, self.hash.hexdigest()


def summaries(rows: DataFrame) -> DataFrame:
    """Counts of faults and the repaired text's hash of every conversation with rows, read row by row in order."""
    ordered = rows.repartition("key").sortWithinPartitions("key", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "conv", "turn", "role", "text", "letters", "chunk", "edits"))):
                if row[0] != key:
                    if now:
                        out.append(now.row())
                    key, now = row[0], Summary(row[1])
                now.add(*row[2:])
            yield summary_batch(out)
        if now:
            yield summary_batch([now.row()])

    def summary_batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 6, pa.string()])], [x.split()[0] for x in STATISTICS.split(", ")])

    return ordered.mapInArrow(run, STATISTICS)


def repair(conversations: DataFrame, most: int = CHUNK) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage.

    Null ids are one conversation, null turns come first; rows of one turn are ordered
    by role, then by text's digest, so that repeated rows are neighbours. Missing roles
    and texts are one space: such a text is blank, such a role fits nowhere. Of roles the
    first letter counts. Texts may have any length. A conversation of which no row is
    left has zeros, an empty audit and the hash of an empty text. No rows give no rows;
    further columns don't count.
    """
    rows = damaged(conversations)
    rows = rows.withColumn("key", F.coalesce(F.col("conv").cast("string"), F.lit(""))).withColumn("digest", F.sha2("text", 256))
    rows = numbered(rows, "key", ["turn", "role", "digest"], conversations.select("conv_id").count())
    rows = cut(faulty(rows).withColumn("chunk", F.floor(F.col("at") / most).cast("long")))
    planned = cut(plans(chunk_answers(rows, most)))
    found = summaries(rows.join(planned.select("key", "chunk", "edits"), ["key", "chunk"]))
    prices = planned.where("chunk = 0").select(F.col("key").alias("id"), "cost", "audit")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    ids = ids.withColumn("id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    found = found.withColumn("id", F.coalesce(F.col("conv").cast("string"), F.lit(""))).drop("conv")
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    joined = ids.join(found, "id", "left").join(prices, "id", "left")
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def sql_with(prefix: str, cost: str, edit: str, line: str) -> str:
    """A prefix (cost in eight digits, edits, a mark, text) and one edit more; prefixes compare by cost, then by edits."""
    return f"lpad(CAST(CAST(left({prefix}, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr(split_part({prefix}, chr(1), 1), 9) || '{edit}' || chr(1) || substr({prefix}, instr({prefix}, chr(1)) + 1) || {line}"


def sql_inserted(s: str, u: str, a: str, n: str) -> str:
    """The states' prefixes once insertions are offered: users after each other state, assistants after users."""
    line = {r: f"chr(10) || '{NAMES[r]}:'" for r in NAMES}
    user = f"least({u}, {', '.join(sql_with(x, str(INSERT), 'I', line[USER]) for x in (n, s, a))})"
    return f"SELECT conv, nth, none, s, u1 AS u, least(a, {sql_with('u1', str(INSERT), 'I', line[ASSISTANT])}) AS a FROM (SELECT *, {user} AS u1 FROM"


def sql_step() -> str:
    """One row more: from each state's best prefix to the best of each state after it."""
    stay = f"CASE WHEN fault = 't' THEN {CUT_OFF} ELSE 0 END"
    free = "fault NOT IN ('b', 'd')"
    kept = lambda x, i: f"CASE WHEN {free} AND initial = '{i}' THEN {sql_with(x, stay, 'K', sql_line)} END"
    sql_line = "chr(10) || role || ':' || text"
    changed = lambda x, r: f"CASE WHEN {free} THEN {sql_with(x, f'{REROLE} + {stay}', 'R', f'chr(10) || {chr(39)}{NAMES[r]}:{chr(39)} || text')} END"
    gone = lambda x: sql_with(x, str(DELETE), "D", "''")
    users = ", ".join(f for x in ("none", "s", "a") for f in (kept(x, "u"), changed(x, USER)))
    return f"""SELECT b.conv, b.nth + 1 AS nth, {gone("none")} AS none, least({gone("s")}, {kept("none", "s")}) AS s,
        least({gone("u")}, {users}) AS u, least({gone("a")}, {kept("u", "a")}, {changed("u", ASSISTANT)}) AS a
        FROM best b JOIN coded c ON c.conv = b.conv AND c.nth = b.nth"""


#: Bytes mixed in one by one, then eight steps of the reflected polynomial.
SQL_KIND = f"""xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
    lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % {KINDS}"""
ORACLE_SQL = f"""
WITH RECURSIVE marked AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {SQL_KIND} AS kind FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM marked WHERE kind <> 0),
ordered AS (
    SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS conv, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS nth,
        rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM damaged),
coded AS (
    SELECT conv, turn, role, text, nth, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS initial,
        CASE WHEN core = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY nth) > 1 THEN 'd' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault
    FROM ordered),
best AS (
    {sql_inserted("s", "u", "a", "none")} (SELECT DISTINCT conv, CAST(0 AS BIGINT) AS nth, '00000000' || chr(1) AS none, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM coded))
    UNION ALL {sql_inserted("s", "u", "a", "none")} ({sql_step()}))),
sizes AS (
    SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT *, lag(initial) OVER (PARTITION BY conv ORDER BY nth) AS before FROM coded) GROUP BY conv),
ended AS (SELECT sizes.*, least(none, a) AS x FROM sizes JOIN best ON best.conv = sizes.conv AND best.nth = sizes.n)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(CAST(left(x, 8) AS BIGINT), 0) AS cost, coalesce(substr(split_part(x, chr(1), 1), 9), '') AS audit, sha256(coalesce(substr(x, instr(x, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN ended ON ended.conv = coalesce(CAST(ids.conv_id AS VARCHAR), '')
"""
