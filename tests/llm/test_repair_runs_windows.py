"""Conversation repair, periodic runs and repeated windows against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from wiretally.llm import dialogue_repair, periodic_runs, word_windows

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, runs string, `a.b` string, chunk long, doc string"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and very long texts, ties, repeated rows, clashing and dotted columns."""
    draw = random.Random(3)
    prose = lambda n, kinds=9: " ".join(draw.choices([f"wörd{k}" for k in range(kinds)], k=n))
    shared, looped = prose(45, 900), " ".join(["a b c"] * 30)
    texts = [None, "", " \t\n", "one", prose(40), shared, f"{prose(30)} {shared} {prose(9)}\n{shared}", looped, f"x {looped} y", " ".join(["z"] * 30_000),
             prose(25_000, 20_000), "\x1c.. 　 é", " ".join([*"ab" * 500, *"cd" * 500])]
    rows = [(10 * k, x) for k, x in enumerate(texts)] + [(50, shared), (50, shared + " tail"), (None, shared), (None, None), (90, "other"), (-4, prose(60))]
    return spark.createDataFrame([(d, x, "en", "r", "c", 1, "d") for d, x in rows], DOC)


# 11

def legal(roles):
    return re.fullmatch(r"(s?(ua)+)?", roles) is not None


def every_way(turns):
    """Least (cost, edits) of (role initial, truncated, must go) by trying all of them."""
    best = (10 ** 9, "")

    def go(i, roles, edits, cost):
        nonlocal best
        if cost > best[0] or not re.fullmatch(r"s?(ua)*u?", roles):
            return
        for k in range(4):
            for put in itertools.product("ua", repeat=k):
                r, e, c = roles + "".join(put), edits + "I" * k, cost + 3 * k
                if not re.fullmatch(r"s?(ua)*u?", r):
                    continue
                if i == len(turns):
                    best = min(best, (c, e)) if legal(r) else best
                    continue
                initial, truncated, forced = turns[i]
                go(i + 1, r, e + "D", c + 4)
                if not forced:
                    go(i + 1, r + (initial or "?"), e + "K", c + 3 * truncated)
                    for new in "ua":
                        go(i + 1, r + new, e + "R", c + 3 + 3 * truncated)

    go(0, "", "", 0)
    return best


def plain_viterbi(turns):
    """The same with whole strings, for longer conversations."""
    best = {0: (0, "")}
    for turn in turns:
        new = {}
        for source, target, cost, edits in dialogue_repair.steps(*turn):
            if source in best:
                way = (best[source][0] + cost, best[source][1] + edits)
                new[target] = min(new.get(target, way), way)
        best = new
    return min((best[s][0] + cost, best[s][1] + edits) for s, _, cost, edits in dialogue_repair.ENDS if s in best)


def draw_turns(draw, n):
    roles = draw.choice([["s", "u", "a", "t"], ["t"], ["u", "a"], ["u", "a", "a", "s"], ["s", "t", ""]])
    cut, gone = draw.choice([0, .3, 1]), draw.choice([0, .25, .9])
    return [(draw.choice(roles), draw.random() < cut, draw.random() < gone) for _ in range(n)]


def test_least_edits_of_short_conversations():
    draw = random.Random(1)
    for _ in range(400):
        turns = draw_turns(draw, draw.randrange(6))
        cost, edits = dialogue_repair.least_edits(turns)
        assert (cost, edits.replace("@", "D")) == every_way(turns)


def test_survivors_of_long_conversations_and_of_their_pieces():
    draw = random.Random(2)
    for _ in range(300):
        turns = draw_turns(draw, draw.choice([10, 60, 200]))
        expected = plain_viterbi(turns)
        assert dialogue_repair.least_edits(turns) == expected
        over, at = dialogue_repair.Survivors(0), 0
        while at < len(turns):
            n, ways = draw.randrange(1, 40), []
            for source in dialogue_repair.STATES:
                part = dialogue_repair.Survivors(source)
                for turn in turns[at:at + n]:
                    part.step(dialogue_repair.steps(*turn))
                settled = part.take()
                ways += [(source, t, cost, settled + part.undecided(t)) for t, (cost, _) in part.paths.items()]
            over.step(ways)
            at += n
        over.step(dialogue_repair.ENDS)
        assert (over.paths[0][0], over.take()) == expected


def nodes(node):
    return 1 + sum(map(nodes, node.children))


def test_what_is_undecided_stays_small():
    draw = random.Random(4)
    search, most = dialogue_repair.Survivors(0), 0
    for k in range(20_000):
        search.step(dialogue_repair.steps("ua"[k % 2] if draw.random() < .8 else draw.choice("uast"), draw.random() < .1, draw.random() < .1))
        assert nodes(search.root) <= 7
        most = max(most, *(len(search.undecided(s)) for s in search.paths))
    assert most < 200
    a, b = dialogue_repair.Survivors(0), dialogue_repair.Survivors(0)
    for n in (1, 5, 0, 2):
        a.step(dialogue_repair.steps("u", True, False))
        b.step(dialogue_repair.steps("u", True, False))
        a.forced(n)
        for _ in range(n):
            b.step(dialogue_repair.steps("", False, True))
        assert {s: (c, a.undecided(s)) for s, (c, _) in a.paths.items()} == {s: (c, b.undecided(s)) for s, (c, _) in b.paths.items()}


def brute_repair(rows, damage=True):
    kept = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text, code = " " if role is None else role, " " if text is None else text, None
        bucket = kept[conv]
        if damage:
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        bucket += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = []
    for conv, turns in kept.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        counts, seen, marked, numbers = collections.Counter(), set(), [], {t for t, _, _ in turns if t is not None}
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, edits = plain_viterbi(marked)
        lines, state, left = [], 0, iter(turns)
        for e in edits:
            role, text = ("", "") if e == "I" else next(left)[1:]
            if e in "@D":
                continue
            if e in "RI":
                role = "assistant" if state == 2 else "user"
            state = dialogue_repair.AFTER[state, role[0]]
            lines.append(f"{role}:{text}")
        out.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, counts["blank"], counts["duplicate"], counts["truncated"],
                    illegal, cost, edits.replace("@", "D"), hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def test_repaired_conversations(spark):
    draw = random.Random(5)
    kind = "conv_id long, turn long, role string, text string, edits string, `a.b` long, kind long"
    texts = ["Yes.", "No", "Well then!", "", " \n", None, "So?  ", "ok. \x0b", "é" * 3000 + "."]
    hot = [(7, draw.choice([None, *range(400)]), draw.choice(["user", "assistant", "system", None, "tool"]), draw.choice(texts)) for _ in range(1500)]
    same = [(8, 3, "user", "Again.")] * 300
    rows = hot + same + [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi.")] + [
        (c, draw.choice([t, t, t, 2 * t, None]), draw.choice(["user", "assistant", "system", "", "User"]), draw.choice(texts))
        for c in range(100, 400) for t in range(draw.randrange(1, 9))]
    table = spark.createDataFrame([(*r, "e", 1, 2) for r in rows], kind)
    for damage in (True, False):
        got = [tuple(r) for r in dialogue_repair.repair_digests(table, damage).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute_repair(rows, damage)))
    assert sum(r.conv_id == 7 for r in dialogue_repair._pieces(  # the hot conversation is no single task
        table, dialogue_repair.turns_of(table), dialogue_repair._first_turns(dialogue_repair.turns_of(table))).collect()) > 1
    turns = dialogue_repair.repaired_turns(table).collect()
    roles = collections.defaultdict(str)
    for r in turns:
        roles[r.conv_id] += r.role[0]
    assert all(map(legal, roles.values())) and {r.edit for r in turns} <= set("KRI")
    assert dialogue_repair.repair_digests(table.limit(0), True).count() == dialogue_repair.repaired_turns(table.limit(0)).count() == 0


def test_repair_of_the_given_conversations(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = dialogue_repair.repair_digests(table, True)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_repair([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]))


# 12

def brute_runs(x):
    out, n = [], len(x)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q):
                part = x[start:start + length]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((start, length, q))
            i += i == start or i + q < n
    return sorted(out)


def test_runs_of_words():
    draw = random.Random(7)
    for trial in range(1500):
        n = draw.choice([0, 1, 5, 6, 7, 20, 60, 200, 1200 if trial % 20 == 0 else 90])
        x = [draw.randrange(draw.choice([1, 2, 3, 50])) for _ in range(n)]
        for _ in range(draw.randrange(4) if n >= 8 else 0):
            p, start = draw.randrange(1, max(2, n // 4)), draw.randrange(n)
            unit = [draw.randrange(draw.choice([2, 3, 1000])) for _ in range(p)]
            for k in range(min(n - start, int(p * draw.uniform(2.5, 9)))):
                x[start + k] = unit[k % p]
        assert periodic_runs.runs_of(np.array(x, np.int64)) == brute_runs(x)


def test_long_periods_and_many_texts_together():
    draw = random.Random(8)
    unit = [draw.randrange(10_000) for _ in range(5000)]
    x = [1, 2] + unit * 4 + unit[:17] + [3]
    assert periodic_runs.runs_of(np.array(x, np.int64)) == [(2, 20_017, 5000)]
    assert periodic_runs.runs_of(np.array((unit * 4)[:-1], np.int64)) == []
    texts = [[b"a"] * 5, [b"a"] * 6, [], [b"a", b"b"] * 4, [b"a", b"b"] * 4, [str(k).encode() for k in unit[:30]] * 5]
    assert periodic_runs.runs_of_many(texts) == [[], [(0, 6, 1)], [], [(0, 8, 2)], [(0, 8, 2)], [(0, 150, 30)]]


def brute_digest(doc_id, text):
    words = (text or "").encode().split()
    h, n = None if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    runs = brute_runs([number[w] for w in words]) if n < 3000 else periodic_runs.runs_of(np.array([number[w] for w in words]))
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    return (doc_id, len(runs), *(best[0] if best else (None,) * 3), best[0][1] * 1000 // best[0][2] if best else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())


def test_run_digests(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (odd, docs.where("n_chars < 9000")):
        got = periodic_runs.run_digests(table)
        assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        rows = [tuple(r) for r in got.collect()]
        assert sorted(map(repr, rows)) == sorted(repr(brute_digest(r.doc_id, r.text)) for r in table.select("doc_id", "text").collect())
        assert any(r[1] for r in rows)
    assert periodic_runs.run_digests(none).count() == 0


# 13

def brute_windows(rows, size=20):
    words = [(word_windows.LAST if d is None else d, (x or "").encode().split()) for d, x in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            least[key] = min(least.get(key, d), d)
    out = []
    for (doc_id, _), (d, w) in zip(rows, words, strict=True):
        covered, seen = np.zeros(len(w), bool), set()
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            if least[key] < d or key in seen:
                covered[i:i + size] = True
            seen.add(key)
        kept = b" ".join(x for x, c in zip(w, covered.tolist(), strict=True) if not c)
        out.append((doc_id, kept.decode(), len(w), int(covered.sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("sizes", [{}, {"chunk": 30_000, "block": 3_000}])
def test_repeated_windows(spark, odd, none, sizes):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (odd, docs):
        rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
        expected = brute_windows(rows)
        got = word_windows.cut_repeats(table.repartition(3), **sizes)
        assert got.columns == ["doc_id", "text", "n_words", "n_removed", "kept_sha256"]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
        assert sum(r[3] for r in expected) > 1000
    assert word_windows.cut_repeats(none, **sizes).count() == 0


def test_sketch_never_underestimates():
    draw = np.random.default_rng(9)
    lists = [np.unique(draw.integers(0, 1 << 26, n)) for n in (0, 1, 5000, 70_000)] + [np.arange(3000), np.arange(2000, 5000)]
    count = collections.Counter(v for x in lists for v in x.tolist())
    found = word_windows.estimates(lists)
    values = np.concatenate(lists).tolist()
    assert all(e >= count[v] for v, e in zip(values, found.tolist(), strict=True))
    assert sum(e > count[v] for v, e in zip(values, found.tolist(), strict=True)) < len(values) / 10
    assert all((word_windows.unpacked(word_windows.packed(x)) == x).all() for x in lists)
