"""Conversation operators against brute force: nulls, empty tables, repeated rows, ties, long conversations over many tasks, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from postlens.llm import repair, running, trie

SCHEMA = "conv_id long, turn long, role string, text string, n long, depth long, chunk long, code string, key string, owner string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, None, 2, "c", None, "o") for r in rows], SCHEMA)


def made(seed, n, long=0):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(0, 7)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c * r.choice([1, 1, 1]), r.choice([t, t, t, t + 3, None]), role, r.choice(["Hello.", "What?", "no end", "  ", "", None, f"{r.random()}!", "same words. ", "a b c"])))
    rows += [(7, t, ("user", "assistant")[t % 2], f"turn {t} of many" + ".!?,"[t % 4]) for t in range(long)]
    rows += [(40, 1, "user", "Twice."), (40, 1, "user", "Twice."), (60, None, None, None), (None, 1, "user", "No id."), (None, 2, "assistant", "None.")]
    return rows


def in_order(rows, empty):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t, empty if role is None else role, empty if text is None else text))
    low = lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())
    return {c: sorted(v, key=low) for c, v in convs.items()}


def repaired(turns):
    """Forward search over (state, cost, initials, turns), one way of each state at a time."""
    seen, kinds = set(), []
    for _, role, text in turns:
        bare = text.strip(" \t\n\v\f\r")
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    nexts = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    full = {"u": "user", "a": "assistant"}

    def inserted(ways):
        for _ in range(3):
            for s, (cost, audit, out) in list(ways.items()):
                for i, role in full.items():
                    if (s, i) in nexts:
                        new = (cost + 5, audit + "I", [*out, f"{role}:"])
                        ways[nexts[s, i]] = min(ways.get(nexts[s, i], new), new)
        return ways

    ways = {0: (0, "", [])}
    for (_, role, text), kind in zip(turns, kinds):
        ways, after = inserted(ways), {}
        for s, (cost, audit, out) in ways.items():
            options = [(s, (cost + 2, audit + "D", out))]
            if kind not in ("blank", "duplicate"):
                extra = 5 * (kind == "truncated")
                options += [(nexts[s, role[:1]], (cost + extra, audit + "K", [*out, f"{role}:{text}"]))] if (s, role[:1]) in nexts else []
                options += [(nexts[s, i], (cost + 1 + extra, audit + "R", [*out, f"{r}:{text}"])) for i, r in full.items() if (s, i) in nexts]
            for t, way in options:
                after[t] = min(after.get(t, way), way)
        ways = after
    ways = inserted(ways)
    cost, audit, out = min(ways[s] for s in (0, 3) if s in ways)
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damage(rows):
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            yield from [row] * (2 if k == 3 else 1)


@pytest.mark.parametrize("chunk", [256, 3])
def test_repair(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = made(1, 120, 300)
    told = in_order(damage(rows), " ")
    df = table(spark, rows).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in repair.audited(df, repair.ready(repair.damaged(df))).collect()}
    assert set(got) == {c for c, *_ in rows}
    assert got == {c: repaired(told.get(c, [])) for c in got}


def test_repair_of_no_rows(spark):
    df = table(spark, [])
    assert repair.audited(df, repair.ready(df)).count() == 0
    one = table(spark, [(0, 0, "user", "Hi.")])
    got = repair.audited(one, repair.ready(one.where("false"))).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_every_signature_of_few_rows():
    """All edits with at most two inserts at each place, tried one by one."""
    nexts = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def tried(signature, start):
        found = {start: [(0, "")]}
        for kind in signature:
            after = defaultdict(list)
            for s, ways in found.items():
                for cost, audit in ways:
                    for inserts in ("", "u", "a", "ua", "au"):
                        t = s
                        for i in inserts:
                            t = nexts.get((t, i))
                        if t is None:
                            continue
                        paid, text = cost + 5 * len(inserts), audit + "I" * len(inserts)
                        after[t].append((paid + 2, text + "D"))
                        if kind != "d":
                            for i, price, letter in [("u", 1, "R"), ("a", 1, "R"), (kind.lower(), 0, "K")]:
                                if (t, i) in nexts:
                                    after[nexts[t, i]].append((paid + price + 5 * kind.isupper(), text + letter))
            found = after
        return found

    for n in range(4):
        for signature in map("".join, product("suaxSUd", repeat=n)):
            costs, _, codes = repair.solve(signature)
            for a in range(4):
                best = tried(signature, a)
                for z in range(4):
                    want = min(best[z]) if best.get(z) else (repair.FAR, "")
                    assert costs[4 * a + z] == want[0] and (want[0] == repair.FAR or codes[4 * a + z].translate(repair.INITIALS) == want[1])


def test_solutions_are_shared(spark, monkeypatch):
    """As many signatures are solved as there are distinct ones."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"Text {c} {t}.") for c in range(200) for t in range(4 + 2 * (c % 2))]
    made_ = repair.chunks(repair.faults(repair.ready(table(spark, rows))))
    assert {r.signature for r in made_.collect()} == {"uaua", "uauaua"}


def nodes(rows):
    own = {c: [(r, t) for _, r, t in v] for c, v in in_order(rows, "").items() if c is not None}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = lambda q: [x for x in members if len(x) == len(q) + 1 and x[:-1] == q]
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below if q)
        ends = hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest()
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), len(kids(p)), sum(not kids(q) for q in below), saved, ends, len(below))
    return out


def found(df):
    got = trie.nodes(*trie.shared_openings(trie.hashed(trie.turns(df)))).collect()
    return {(r.conv_id, r.depth): r for r in got}, len(got)


def test_trie(spark):
    r = random.Random(5)
    rows = [x for x in made(2, 45) if x[0] is None or x[0] % 9]
    # copies, prefixes and branches at many depths
    for c in range(100, 160):
        rows += [(c, t, "user", f"{'shared' if t < r.randint(1, 9) else r.choice('xy')} {t}") for t in range(r.randint(1, 9))]
    rows += [(200 + c, t, "user", f"grows {t} on") for c in range(8) for t in range(c)] + [(308 - c, t, "user", f"shrinks {t}") for c in range(8) for t in range(c)]
    want = nodes(rows)
    got, n = found(table(spark, rows).repartition(3))
    assert n == len(want) and set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        assert (g.parent_conv_id, g.n_convs, g.n_children, g.n_leaves, g.saved_tokens, g.ends_sha256, g.stop - g.start) == w, k
    assert sorted(g.start for g in got.values()) == list(range(n))


def test_trie_of_no_rows(spark):
    assert found(table(spark, []))[1] == 0
    got, n = found(table(spark, [(1, None, None, None), (None, 1, "user", "x")]))
    # the only conversation starts at its second turn, and there is no conversation 0 to open it
    assert n == 1 + (zlib.crc32(b"1") % 4 < 1) and got[1, 0].n_leaves == 1


def test_running_sums_over_borders(spark):
    rows = [(None, i) for i in range(300)] + [(5, i) for i in range(700)] + [(i, 0) for i in range(6, 200)]
    df = spark.createDataFrame(rows, "g long, i long").withColumn("v", F.col("i") * 7 + 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        out = running.running_sums(df.repartition(7), "g", ["i"], ["i"], ["v"], "t", 11).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len(rows) and all(x.v == x.i * (x.i + 1) // 2 * 7 + x.i + 1 for x in out)
