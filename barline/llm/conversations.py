"""Repair of conversations: the cheapest edits that make the turns alternate, with an audit of the edits.

A conversation is a stream of rows in the order of its turns. Edits keep, rerole or delete a row or insert an
empty turn; the roles that result must be nothing or an optional system turn and then pairs of user and
assistant. A dynamic program over four states (nothing yet, after the system turn, after a user, after an
assistant) holds for each state the cheapest audit so far and, among equally cheap ones, the least string.

Audits are nodes of a tree: a node is an edit appended to its parent, so candidates share their prefixes and
an edit costs one node. A node knows its ancestors at distances of powers of two and a rolling hash of its
string; two audits are compared by searching for their longest common prefix along those ancestors. Equal
strings are the same node, so a hash collision shows as two nodes where one was expected, and then the strings
themselves decide. What all states agree on is written out from time to time, and their hashers of the repaired
text run along, so a conversation of any length needs memory for its audit and the digests of its rows only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import query, table

BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn of a role's initial, by the state before it.
NEXT = {
    START: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": ASSISTANT},
    ASSISTANT: {"u": USER},
}
#: The role that an inserted or reroled turn takes, by the state before it.
TURN = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
LEGAL = {"su", "ua", "au"}
#: Rows after which what all states share is written out.
REBASE = 2048
MODULUS, BASE = (1 << 61) - 1, 911_382_323


class Audits:
    """Strings that share their prefixes. Node 0 is the empty string."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.collisions = 0
        self.clear()

    def clear(self) -> None:
        self.char, self.depth, self.hash, self.up = [""], [0], [0], [()]
        self.children: dict[tuple[int, str], int] = {}

    def add(self, node: int, char: str) -> int:
        found = self.children.get((node, char))
        if found is not None:
            return found
        new = self.children[node, char] = len(self.char)
        up, k = [node], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.char.append(char)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(char)) % self.modulus)
        self.up.append(tuple(up))
        return new

    def at_depth(self, node: int, depth: int) -> int:
        while (above := self.depth[node] - depth) > 0:
            node = self.up[node][above.bit_length() - 1]
        return node

    def string(self, node: int) -> str:
        out = []
        while node:
            out.append(self.char[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.at_depth(a, depth), self.at_depth(b, depth)
        if x == y:
            return self.depth[a] < self.depth[b]
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]):
                far, other = self.up[x][k], self.up[y][k]
                if self.hash[far] != self.hash[other]:
                    x, y = far, other
        if self.up[x][0] != self.up[y][0]:
            self.collisions += 1
            return self.string(a) < self.string(b)
        return self.char[x] < self.char[y]


class Repair:
    """The program over one conversation's rows, given in order."""

    def __init__(self, audits: Audits | None = None, rebase: int = REBASE):
        self.audits = audits or Audits()
        self.rebase = rebase
        self.written: list[str] = []
        self.rows = 0
        # state: (cost, audit, hasher of the repaired text, whether it has a turn)
        self.best = {START: (0, 0, hashlib.sha256(), False)}
        self._inserts()

    def _better(self, cost: int, node: int, than) -> bool:
        if than is None or cost != than[0]:
            return than is None or cost < than[0]
        return node != than[1] and self.audits.less(node, than[1])

    @staticmethod
    def _said(hasher, begun: bool, role: str, text: str):
        hasher = hasher.copy()
        hasher.update((("\n" if begun else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        return hasher

    def _inserts(self) -> None:
        again = True
        while again:
            again = False
            for state in sorted(self.best):
                cost, node, hasher, begun = self.best[state]
                role = TURN[state]
                to, cost, node = NEXT[state][role[0]], cost + COST[INSERT], self.audits.add(node, INSERT)
                if self._better(cost, node, self.best.get(to)):
                    self.best[to] = (cost, node, self._said(hasher, begun, role, ""), True)
                    again = True

    def row(self, role: str, text: str, gone: bool, truncated: bool) -> None:
        """One more row. ``gone``: it must be deleted."""
        new: dict[int, tuple] = {}
        for state, (cost, node, _, _) in self.best.items():
            moves = [(state, DELETE, None)]
            if not gone:
                if role[:1] in NEXT[state]:
                    moves.append((NEXT[state][role[:1]], KEEP, role))
                moves.append((NEXT[state][TURN[state][0]], REROLE, TURN[state]))
            for to, edit, said in moves:
                total = cost + COST[edit] + (TRUNCATED if truncated and edit != DELETE else 0)
                grown = self.audits.add(node, edit)
                if self._better(total, grown, new.get(to)):
                    new[to] = (total, grown, state, said)
        self.best = {
            to: (cost, node, *self.best[state][2:])
            if said is None
            else (cost, node, self._said(*self.best[state][2:], said, text), True)
            for to, (cost, node, state, said) in new.items()
        }
        self._inserts()
        self._drop_hopeless()
        self.rows += 1
        if self.rows % self.rebase == 0:
            self._write_out()

    def _drop_hopeless(self) -> None:
        """Whatever follows, a conversation that stands after an assistant can go on like one after the system
        turn, and like one with nothing yet if it deletes one system turn more."""
        cost = self.best[ASSISTANT][0] if ASSISTANT in self.best else None
        for state, more in ((SYSTEM, 0), (START, COST[DELETE])):
            if cost is not None and state in self.best and self.best[state][0] > cost + more:
                del self.best[state]

    def _write_out(self) -> None:
        paths = {state: self.audits.string(entry[1]) for state, entry in self.best.items()}
        low, high = min(paths.values()), max(paths.values())
        shared = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        self.written.append(low[:shared])
        self.audits.clear()
        for state, path in paths.items():
            node = 0
            for char in path[shared:]:
                node = self.audits.add(node, char)
            self.best[state] = (self.best[state][0], node, *self.best[state][2:])

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired text)"""
        end = self.best[START] if START in self.best else None
        if ASSISTANT in self.best:
            cost, node, *_ = self.best[ASSISTANT]
            if self._better(cost, node, end):
                end = self.best[ASSISTANT]
        return end[0], "".join(self.written) + self.audits.string(end[1]), end[2].hexdigest()


def repaired(role_texts: Iterator[tuple[str | None, str, str]]) -> dict:
    """Counts and the cheapest edits of one conversation's (turn, role, text) rows, in order."""
    seen: set[bytes] = set()
    turns, lowest, highest, last_turn = 0, None, None, None
    counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    before, program = None, Repair()
    for turn, role, text in role_texts:
        if turn is not None and turn != last_turn:
            turns, last_turn = turns + 1, turn
            lowest, highest = int(turn) if lowest is None else lowest, int(turn)
        name = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        said = text.rstrip(BLANKS)
        fault = "blank" if not said else "duplicate" if name in seen else "truncated" if said[-1] not in STOPS else None
        seen.add(name)
        if fault:
            counts[fault] += 1
        if before is not None and before + role[:1] not in LEGAL:
            counts["illegal"] += 1
        before = role[:1]
        program.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")
    cost, audit, sha = program.result()
    gaps = highest - lowest + 1 - turns if turns else 0
    return {"gaps": gaps, **counts, "cost": cost, "audit": audit, "repaired_sha256": sha}


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    copies: Column | None = None,
) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, missing turns first; rows of one turn by role and then text. A row counts
    ``copies`` times (once if that is not given; a row of 0 copies only names its conversation). Null roles
    and texts count as one blank, null conv_ids are one conversation. Turns must be whole numbers. A role that
    is an empty string has no initial and is never kept. An empty table gives an empty result, and other columns
    are not looked at.

    A conversation is one sorted stream in one task, since the digest of its repaired text runs over its
    rows in order; the task keeps its audit and 16 bytes for each of its rows.
    """
    kind = rows.schema[conv_col].dataType
    narrow = rows.select(
        F.col(conv_col).cast("string").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        (F.lit(1) if copies is None else copies).cast("int").alias("copies"),
    )
    ordered = narrow.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        out = []
        for conv, group in groupby(stream, key=lambda r: r[0]):
            made = repaired(r[1:4] for r in group for _ in range(r[4]))
            out.append({"conv": conv, **made})
            if len(out) >= 2000:
                yield pd.DataFrame(out)
                out = []
        if out:
            yield pd.DataFrame(out)

    made = ordered.select("conv", F.col("turn").cast("string").alias("turn"), "role", "text", "copies").mapInPandas(
        run, "conv string, " + RESULT
    )
    return made.select(F.col("conv").cast(kind).alias("conv_id"), *made.columns[1:])


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """(conversations damaged by the remainder of crc32(conv_id:turn) by 20, copies of each row): 0 drops a
    row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes it the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = part("text")
    out = rows.select("conv_id", "turn", part("role").alias("role"), text.alias("text"), kind.alias("kind"))
    stops = F.regexp_replace("text", "[.!?]", "")
    out = out.withColumns({
        "text": F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, stops).otherwise(F.col("text")),
        "role": F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")),
    })
    return out, F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)


#: crc32 by bits, the damage, the faults, and the program with whole strings as audits.
OP13_SQL = """
    WITH RECURSIVE keyed AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
      FROM conversations),
    kinds AS (
      SELECT *, xor(list_reduce(
        list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT)),
        lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
          lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, byte)), 4294967295::BIGINT),
        4294967295::BIGINT) % 20 AS kind
      FROM keyed),
    damage AS (
      SELECT conv_id, turn, kind, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy,
             CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM kinds),
    ordered AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
             regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS said
      FROM damage),
    marked AS (
      SELECT *, said = '' AS blank,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
      FROM ordered),
    faults AS (
      SELECT *, CASE WHEN blank THEN 'b' WHEN again THEN 'd' WHEN said NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
      FROM marked),
    ins(f, m, edits, said) AS (VALUES
      (0, 0, '', []::VARCHAR[]), (1, 1, '', []::VARCHAR[]), (2, 2, '', []::VARCHAR[]), (3, 3, '', []::VARCHAR[]),
      (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 2, 'I', ['user:']),
      (1, 3, 'II', ['user:', 'assistant:']), (2, 3, 'I', ['assistant:']), (3, 2, 'I', ['user:'])),
    moves(m, initial, t, edit, price) AS (VALUES
      (0, '*', 0, 'D', 4), (1, '*', 1, 'D', 4), (2, '*', 2, 'D', 4), (3, '*', 3, 'D', 4),
      (0, 's', 1, 'K', 0), (0, 'u', 2, 'K', 0), (1, 'u', 2, 'K', 0), (2, 'a', 3, 'K', 0), (3, 'u', 2, 'K', 0),
      (0, '*', 2, 'R', 3), (1, '*', 2, 'R', 3), (2, '*', 3, 'R', 3), (3, '*', 2, 'R', 3)),
    dp AS (
      SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, []::VARCHAR[] AS parts
      FROM conversations
      UNION ALL
      SELECT conv_id, i, state, cost, audit, parts FROM (
        SELECT d.conv_id, r.i, v.t AS state,
               d.cost + 3 * length(n.edits) + v.price + CASE WHEN v.edit <> 'D' AND r.fault = 't' THEN 3 ELSE 0 END AS cost,
               d.audit || n.edits || v.edit AS audit,
               list_concat(list_concat(d.parts, n.said), CASE v.edit
                 WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text]
                 ELSE [CASE v.t WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text] END) AS parts
        FROM dp d JOIN faults r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1
        JOIN ins n ON n.f = d.state
        JOIN moves v ON v.m = n.m AND (v.initial = '*' OR v.initial = left(r.role, 1))
        WHERE v.edit = 'D' OR r.fault NOT IN ('b', 'd'))
      QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
    facts AS (
      SELECT conv_id, count(*) AS n,
             coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
             count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
      FROM faults GROUP BY conv_id),
    ends AS (
      SELECT d.conv_id, d.cost + 3 * length(n.edits) AS cost, d.audit || n.edits AS audit, list_concat(d.parts, n.said) AS parts
      FROM dp d LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM d.conv_id
      JOIN ins n ON n.f = d.state AND n.m IN (0, 3)
      WHERE d.i = coalesce(f.n, 0)
      QUALIFY row_number() OVER (PARTITION BY d.conv_id ORDER BY d.cost + 3 * length(n.edits), d.audit || n.edits) = 1)
    SELECT e.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, coalesce(f.blank, 0) AS blank,
           coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated,
           coalesce(f.illegal, 0) AS illegal, e.cost, e.audit, sha256(array_to_string(e.parts, chr(10))) AS repaired_sha256
    FROM ends e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
    """


@query("op13_conversation_repair", OP13_SQL)
def op13_conversation_repair(spark, sf_dir):
    rows, copies = damaged(table(spark, sf_dir, "conversations"))
    return repair_conversations(rows, copies=copies)
