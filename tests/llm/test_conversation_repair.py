import hashlib
import itertools
import random
import re
import zlib

import pytest

from quantloom.llm import conversation_repair as cr

SPACES = " \t\n\x0b\x0c\r"


def brute(rows):
    """The report of rows (conv_id, turn, role, text) by one pass that holds all of a conversation's cheapest edits for each state."""
    out = {}
    for c in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in [r for r in rows if r[0] == c]:
            role, text = " " if role is None else role, " " if text is None else text
            fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if fate == 0:
                continue
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            own += [((turn is not None, turn or 0), "user" if fate == 4 else role, text)] * (1 + (fate == 3))
        own.sort()
        seen, counts = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        best = {0: (0, "", [])}
        for _, role, text in own:
            stripped = text.rstrip(SPACES)
            fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            new = {}
            for state, (cost, audit, kept) in best.items():
                paths = [(state, cost, audit, kept)]
                for _ in range(3):
                    s, k, a, t = paths[-1]
                    role_asked, after = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}[s]
                    options = [(s, k + 2, a + "D", t)]
                    if fault not in ("blank", "duplicate"):
                        more = 5 * (fault == "truncated")
                        options.append((after, k + 1 + more, a + "R", [*t, f"{role_asked}:{text}"]))
                        if role[:1] == role_asked[0]:
                            options.append((after, k + more, a + "K", [*t, f"{role}:{text}"]))
                        if role[:1] == "s" and s == 0:
                            options.append((1, k + more, a + "K", [*t, f"{role}:{text}"]))
                    for to, *found in options:
                        if to not in new or tuple(found[:2]) < new[to][:2]:
                            new[to] = tuple(found)
                    paths.append((after, k + 5, a + "I", [*t, f"{role_asked}:"]))
            best = new
        ends = []
        for state, (cost, audit, kept) in best.items():
            if state in (0, 3):
                ends.append((cost, audit, kept))
            ends += [(cost + 5, audit + "I", [*kept, "assistant:"])] * (state == 2) + [(cost + 10, audit + "II", [*kept, "user:", "assistant:"])] * (state == 1)
        cost, audit, kept = min(ends)
        turns = [t for (dated, t), _, _ in own if dated]
        initials = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def reported(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def random_rows(seed, conversations=150):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "assistant"]
    texts = ["Yes.", "No!", "Why?", "cut off", "", None, "  \n", "Well. ", "a\tb", "x.y"]
    rows = []
    for c in [*range(conversations), None]:
        n = rng.choice([1, 2, 3, 5, 8, 13])
        rows += [(c, rng.choice([k, k, k, None, rng.randrange(n)]), rng.choice(roles) if rng.random() < 0.5 else ("user", "assistant")[k % 2], rng.choice(texts) if rng.random() < 0.5 else f"Line {k}.") for k in range(n)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.selectExpr("*", "1 AS part", "'x' AS fault", "2 AS copies", "3 AS own")
    assert reported(cr.repaired_digests(wide)) == brute(rows)


def test_long_conversations_in_small_blocks_and_groups(spark):
    rng = random.Random(5)
    rows = [(c, k, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice([f"T{k}.", f"T{k}.", "again.", "cut"])) for c, n in ((1, 400), (2, 37), (3, 900)) for k in range(n)]
    rows += [(4, 7, "user", "The same.")] * 500 + [(4, 8, "assistant", "And so."), (4, None, "system", "Be kind.")]
    rows += [(5, k, "user", "The same.") for k in range(600)]
    expected = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert reported(cr.repaired_digests(df, fan=4, block_rows=16)) == expected
    assert reported(cr.repaired_digests(df)) == expected


def test_blocks_combine_to_the_whole():
    rng = random.Random(9)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.random() < 0.3) for _ in range(rng.randrange(1, 60))]
        cost, edits, tail = cr.solve(rows)
        size = rng.randrange(1, 9)
        parts = [rows[k : k + size] for k in range(0, len(rows), size)]
        summaries = []
        for part in parts:
            vectors = [cr.forward(part, s) for s in range(4)]
            summaries.append(([c for v in vectors for c, _ in v], [r for v in vectors for _, r in v]))
        costs, ranks = cr.combine([cr.combine(summaries[: len(summaries) // 2]), cr.combine(summaries[len(summaries) // 2 :])])
        end, total, last = cr.closed(list(zip(costs[:4], ranks[:4], strict=True)))
        states = [0, *cr.cross(summaries, 0, end), end]
        pieces = [e for part, a, b in zip(parts, states[:-1], states[1:], strict=True) for e in cr.hirschberg(part, a, b)]
        assert (total, tuple(pieces), last) == (cost, edits, tail)


def test_empty_table_and_pieces(spark):
    assert cr.repaired_digests(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(c, k, ("user", "assistant")[k % 2], f"Line {k}.") for c in range(40) for k in range(6)]
    report, pieces = cr.repair_conversations(spark.createDataFrame(rows, SCHEMA))
    expected = brute(rows)
    texts = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["conv_id"], r["part"])):
        texts.setdefault(r["conv_id"], []).append(bytes(r["repaired"]))
    for r in report.collect():
        joined = b"\n".join(x for x in texts.get(r["conv_id"], []) if x)
        assert hashlib.sha256(joined).hexdigest() == expected[r["conv_id"]][-1]
