import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from palaver.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, place string, fault string, code string"
GOOD = re.compile(r"(s?(ua)+)?")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "f", "c") for r in rows], SCHEMA)


def damaged(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        held = convs[conv]
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        elif code == 2:
            text = re.sub("[.!?]", "", text)
        elif code == 4:
            role = "user"
        held += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    for held in convs.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return convs


def marks(rows):
    seen, out = set(), []
    for _turn, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repairs(rows, faults):
    """Every edit sequence with at most three insertions between rows: (cost, audit, turns)."""
    def options(row, fault):
        yield 4, "D", []
        if fault in ("blank", "duplicate"):
            return
        extra = 3 if fault == "truncated" else 0
        yield extra, "K", [(row[1], row[2])]
        for role in ("user", "assistant"):
            yield extra + 3, "R", [(role, row[2])]

    gaps = [[(3 * n, "I" * n, list(x)) for n in range(3) for x in itertools.product((("user", ""), ("assistant", "")), repeat=n)]] * (len(rows) + 1)
    steps = [gaps[0]]
    for row, fault, gap in zip(rows, faults, gaps[1:]):
        steps += [list(options(row, fault)), gap]
    for chosen in itertools.product(*steps):
        turns = [t for c in chosen for t in c[2]]
        if GOOD.fullmatch("".join(r[:1] or "?" for r, _ in turns)):
            yield sum(c[0] for c in chosen), "".join(c[1] for c in chosen), turns


def brute(rows, search=repairs):
    out = set()
    for conv, held in damaged(rows).items():
        faults = marks(held)
        turns = [t for t, _, _ in held if t is not None]
        cost, audit, fixed = min(search(held, faults))
        out.add((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                 sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:])), cost, audit,
                 hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()))
    return out


def plain(rows, faults):
    """Left to right over states, for conversations too long for all sequences."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(best):
        for _ in range(3):
            for p, (c, a, t) in list(best.items()):
                for role in ("user", "assistant"):
                    q = step.get((p, role[0]))
                    if q is not None:
                        best[q] = min(best.get(q, (1 << 60,)), (c + 3, a + "I", t + [(role, "")]))
        return best

    best = inserted({0: (0, "", [])})
    for (_turn, role, text), fault in zip(rows, faults):
        new = {}
        for p, (c, a, t) in best.items():
            found = [(p, (c + 4, a + "D", t))]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                found += [(step[p, r[:1]], (c + extra + more, a + e, t + [(r, text)])) for e, more, r in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")) if (p, r[:1]) in step]
            for q, b in found:
                new[q] = min(new.get(q, (1 << 60,)), b)
        best = inserted(new)
    return [b for q, b in best.items() if q in (0, 3)]


ROLES = ("system", "user", "assistant", "tool", "", None)
TEXTS = ("Yes.", "No!", "Why", "", None, " \n", "Ends?\n", "v 1.5", "été.")


def conversation(rng, conv, n):
    return [(conv, rng.choice((i, i, i, i + 1, None)), rng.choice(ROLES[:3] * 3 + ROLES), rng.choice(TEXTS)) for i in range(n)]


def test_equal_to_every_edit_sequence(spark):
    rng = random.Random(7)
    rows = [r for c in range(60) for r in conversation(rng, c, rng.randrange(1, 3))]
    got = repair.report(frame(spark, rows)).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == 60


def test_nulls_ties_repeats_and_empty(spark):
    rng = random.Random(8)
    rows = conversation(rng, None, 12) + conversation(rng, 5, 9) * 2 + [(6, None, None, None), (7, None, "user", None)] + [(8, 1, "user", "Same.")] * 30
    rows += [(9, t, "user", "x" * 300_000 + str(t)) for t in range(3)]
    got = {tuple(r) for r in repair.report(frame(spark, rows)).collect()}
    assert got == brute(rows, plain)
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert [tuple(r) for r in repair.report(frame(spark, [(gone, 0, "user", "Hi.")])).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.report(frame(spark, [])).count() == 0


def test_long_conversation_in_blocks(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.choice(ROLES[:3]), rng.choice(TEXTS) and f"{i} {rng.choice(('.', '?', 'x'))}") for i in range(700)] + conversation(rng, 2, 6)
    placed = repair.ordered(repair.damage(frame(spark, rows)).repartition(3))
    marked = repair.faults(placed)
    want = {r[0]: r for r in brute(rows, plain)}
    for block, fan in ((256, 64), (5, 2), (1, 3)):
        got = {int(r.conv_id): r for r in repair.parse(marked, block, fan).collect()}
        assert {c: (r.cost, r.audit, r.illegal) for c, r in got.items()} == {c: (r[6], r[7], r[5]) for c, r in want.items()}
    assert {tuple(r) for r in repair.report(frame(spark, rows)).collect()} == set(want.values())


def test_repaired_turns(spark):
    rng = random.Random(10)
    rows = [r for c in range(40) for r in conversation(rng, c, rng.randrange(1, 9))]
    got = defaultdict(list)
    for r in sorted(repair.repaired(frame(spark, rows)).collect()):
        got[r.conv_id].append((r.role, r.text))
    for conv in range(40):
        held = sorted([(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert got[conv] == min(plain(held, marks(held)))[2]


@pytest.mark.parametrize("text", ["sua", "ua", "uaua", "", "s", "us", "au", "aab", "suuaasu"])
def test_splits_agree(text):
    rows = [repair.row_cell(x, f) for x, f in zip(text, itertools.cycle((0, 3, 0, 1)))]
    whole = repair.fold(rows)
    for cut in range(1, len(rows)):
        assert repair.combine(repair.fold(rows[:cut]), repair.fold(rows[cut:])) == whole
