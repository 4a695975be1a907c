import hashlib
import itertools
import random
import re
import zlib

import pytest

from barline.llm import conversations as op

SCHEMA = "conv_id bigint, turn bigint, role string, text string, copies int, kind string, conv string, audit string"
WANTED = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def plain(rows, longest=3):
    """(cost, audit, digest) of (role, text, gone, truncated) rows by trying all edits with up to ``longest``
    inserted turns between two rows."""
    best = None
    slots = [["I" * n for n in range(longest + 1)]] * (len(rows) + 1)
    choices = [["D"] if gone else ["D", "K", "R"] for _, _, gone, _ in rows]
    for ins in itertools.product(*slots):
        for edits in itertools.product(*choices):
            audit = "".join(i + e for i, e in zip(ins, [*edits, ""]))
            cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[c] for c in audit)
            cost += sum(3 for e, r in zip(edits, rows) if r[3] and e != "D")
            if best and (cost, audit) >= best[:2]:
                continue
            out, todo, last = [], iter(rows), "start"
            for c in audit:
                role, text, *_ = next(todo) if c != "I" else ("", "")
                if c == "D":
                    continue
                if c != "K":
                    role = "assistant" if last == "u" else "user"
                out.append((role, text))
                last = role[:1]
            if WANTED.fullmatch("".join(r[:1] for r, _ in out)) and all(r for r, _ in out):
                best = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
    return best


def random_rows(rnd, n):
    return [
        (rnd.choice(["system", "user", "assistant", "tool", "a", " "]), f"t{i}", rnd.random() < 0.2, rnd.random() < 0.3)
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(12))
def test_edits_against_all_edits(seed):
    rnd = random.Random(seed)
    for n in (0, 1, 2, 3, 4):
        rows = random_rows(rnd, n)
        program = op.Repair()
        for row in rows:
            program.row(*row)
        assert program.result() == plain(rows, 2), rows


def test_collisions_and_rebasing_change_nothing():
    rnd = random.Random(3)
    met = 0
    for n in (5, 60, 400):
        rows = random_rows(rnd, n)
        exact = op.Repair()
        for row in rows:
            exact.row(*row)
        for modulus, rebase in ((1, 10**9), (2, 10**9), (7, 16), (op.MODULUS, 1), (op.MODULUS, 7)):
            audits = op.Audits(modulus)
            program = op.Repair(audits, rebase)
            for row in rows:
                program.row(*row)
            assert program.result() == exact.result()
            met += audits.collisions
    assert met > 0


def test_order_of_audits():
    rnd = random.Random(4)
    for modulus in (op.MODULUS, 1, 3):
        audits = op.Audits(modulus)
        nodes = [0]
        for _ in range(400):
            nodes.append(audits.add(rnd.choice(nodes[-40:]), rnd.choice("DIKR")))
        for _ in range(3000):
            a, b = rnd.choice(nodes), rnd.choice(nodes)
            assert audits.less(a, b) == (audits.string(a) < audits.string(b))


def test_a_long_conversation_keeps_few_nodes():
    program = op.Repair(rebase=500)
    for i in range(20_000):
        program.row("user" if i % 3 else "assistant", "x.", i % 7 == 0, i % 5 == 0)
        assert len(program.audits.char) < 6 * 500 * 2
    cost, audit, _ = program.result()
    assert len(audit.replace("I", "")) == 20_000 and cost > 0


def expected(rows):
    """What the query returns, from plain (conv_id, turn, role, text) rows."""
    out = {}
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs.setdefault(conv, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in mine:
            said = text.strip(BLANK)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                count[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        pairs = zip(mine, mine[1:])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *count.values(), illegal, *plain(judged, 2))
    return out


def test_rows_with_nulls_repeats_and_damage(spark):
    rnd = random.Random(9)
    rows = [(None, None, None, None), (None, 3, "user", "a b."), (1, None, "user", "Hi."), (1, 5, None, "x"), (1, 5, "assistant", "")]
    rows += [(2, 4, "assistant", "Same."), (2, 4, "assistant", "Same."), (2, -1, "system", "Be.\n"), (3, 1, "user", " \n\t")]
    for c in range(10, 60):
        for _ in range(rnd.randint(1, 3)):
            rows.append((c, rnd.choice([None, 0, 1, 2, 9]), rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["A.", "b", "Ünd?", "A. "])))
    docs = spark.createDataFrame([(*r, 7, "k", "c", "a") for r in rows], SCHEMA)
    damaged, copies = op.damaged(docs)
    got = {r[0]: tuple(r[1:]) for r in op.repair_conversations(damaged, copies=copies).collect()}
    assert got == expected(rows)


def test_all_rows_dropped_empty_table_and_extra_columns(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    docs = spark.createDataFrame([(conv, 0, "user", "Hi.", 7, "k", "c", "a")], SCHEMA)
    damaged, copies = op.damaged(docs)
    row = op.repair_conversations(damaged, copies=copies).collect()
    assert [tuple(r) for r in row] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    damaged, copies = op.damaged(docs.where("false"))
    assert op.repair_conversations(damaged, copies=copies).collect() == []
    # With extra columns and no damage.
    assert op.repair_conversations(docs).collect()[0]["audit"] == "KI"


def test_a_very_long_text(spark):
    long = "word " * 200_000 + "end."
    docs = spark.createDataFrame([(1, 0, "user", long, 1, "", "", ""), (1, 1, "assistant", long, 1, "", "", "")], SCHEMA)
    row = op.repair_conversations(docs).collect()[0]
    assert row["audit"] == "KK"
    assert row["repaired_sha256"] == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
