"""Conversation repair against all edits, its tree, and nulls, ties and long conversations."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pytest

from flowbench.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """The least (cost, audit) over every sequence of edits that costs no more than to delete all."""
    best, most = [], C.DELETE * len(rows)

    def go(k, cost, audit, roles):
        if cost > most or not re.fullmatch(r"(s?(ua)*u?)?", roles):
            return
        if k == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            best.append((cost, audit))
        for r in "ua":
            go(k, cost + 5, audit + "I", roles + r)
        if k < len(rows):
            initial, fault = rows[k]
            go(k + 1, cost + 2, audit + "D", roles)
            if fault not in (C.BLANK, C.DUPLICATE):
                more = 5 if fault == C.TRUNCATED else 0
                go(k + 1, cost + more, audit + "K", roles + initial)
                for r in "ua":
                    go(k + 1, cost + more + 1, audit + "R", roles + r)

    go(0, 0, "", "")
    return min(best)


def searched(rows, most=1 << 22):
    repair, edits = C.Repair(most), []
    for k, (initial, fault) in enumerate(rows):
        edits += repair.add(initial and initial + "x", str(k), fault)
    edits += repair.finish()
    return repair, edits


def test_edits_against_all(spark):
    rng = random.Random(13)
    for _ in range(1500):
        rows = [(rng.choice(["s", "u", "u", "a", "a", "z", ""]), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randrange(7))]
        repair, edits = searched(rows, rng.choice((0, 1 << 22)))
        assert (repair.cost, "".join(e for e, _, _ in edits)) == cheapest(rows), rows
        assert [t for e, _, t in edits if e != "I"] == [str(k) for k in range(len(rows))]
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for e, r, _ in edits if e != "D"))


def test_memory_and_time_of_long_conversations():
    """Edits come out as they are certain; where they never are, ties are still compared quickly and rows wait on disk."""
    repair, given, waiting = C.Repair(), 0, 0
    rng = random.Random(4)
    for k in range(20000):
        given += sum(1 for _ in repair.add("ua"[k % 2] if rng.random() < 0.95 else "u", "t", rng.choice((0, 0, 0, 0, 3))))
        waiting = max(waiting, k - given)
    assert waiting < 300 and len(repair.tree.letter) < 3000
    repair, edits = searched([("u", 0)] * 20000, 100)
    assert repair.cost == 10000 and "".join(e for e, _, _ in edits) == "KR" * 10000


def plain(rows):
    """The whole query, conversation by conversation."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            convs[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = []
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in found:
            bare = text.strip(C.SPACE)
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        cost, audit = cheapest([(r[:1], f) for (_, r, _), f in zip(found, faults)])
        roles, lines, at = "", [], 0
        for e in audit:
            due = "assistant" if roles.endswith("u") else "user"
            if e == "I":
                lines.append(f"{due}:")
            else:
                _, role, text = found[at]
                at += 1
                if e == "D":
                    continue
                lines.append(f"{role if e == 'K' else due}:{text}")
            roles += lines[-1].split(":")[0][:1]
        out.append((conv, gaps, *[faults.count(f) for f in (1, 2, 3)], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    texts = ["Good day.", "And you?", "no end", "no end ", " \t", "", None, "Fine!", "é.\n", "a b c"]
    made = [(conv, rng.choice([None, *range(6)]) if rng.random() < 0.2 else t, rng.choice(["system", "user", "user", "assistant", "assistant", None, "", "other"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2], rng.choice(texts)) for conv in [None, *range(150)] for t in range(rng.randrange(1, 6))]
    return made + [(7000 + k, 0, "user", "x") for k in range(60)]


def test_query_against_plain(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = collections.Counter(map(tuple, C.digests(C.damaged(table), table).collect()))
    assert found == collections.Counter(plain(rows)) and max(found.values()) == 1


def test_repaired_rows(spark, rows):
    table = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA + ", fault string")
    out = collections.defaultdict(list)
    for r in C.repaired(table).collect():
        out[r.conv_id].append(r)
    audits = {r.conv_id: r.audit for r in C.digests(table).collect()}
    assert set(out) == {r[0] for r in rows} and len(audits) == len(out)
    for conv, edits in out.items():
        edits.sort(key=lambda r: r.place)
        assert "".join(r.edit for r in edits) == audits[conv] and re.fullmatch(r"(s?(ua)+)?", "".join(r.role[:1] for r in edits if r.edit != "D"))


def test_empty_and_long(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.digests(none, none).count() == C.repaired(none).count() == 0
    long = spark.createDataFrame([(1, t, ("user", "assistant")[t % 2], "word " * 400 + f"{t}.") for t in range(3000)], SCHEMA)
    (row,) = C.digests(long).collect()
    assert row.cost == 0 and row.audit == "K" * 3000 and row.gaps == 0
