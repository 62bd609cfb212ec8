"""Conversation repair against a plain search over all edit sequences."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
import xxhash

from vistaspark.llm import conversations as C
from vistaspark.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, piece string, audit int"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def exhaustive(kinds, most):
    """Least (cost, labels) by trying every sequence of edits with at most ``most`` insertions."""
    best = None
    options = [["D"] if gone else ["D", "K", "Ru", "Ra"] for _, gone, _ in kinds]
    for chosen in itertools.product(*options):
        for n in range(most + 1):
            for places in itertools.combinations_with_replacement(range(len(kinds) + 1), n):
                for given in itertools.product("ua", repeat=n):
                    roles, labels, cost = "", "", 5 * n
                    inserts = collections.defaultdict(str)
                    for p, g in zip(places, given):
                        inserts[p] += g
                    for k in range(len(kinds) + 1):
                        roles += inserts[k]
                        labels += "I" * len(inserts[k])
                        if k < len(kinds):
                            e, (initial, _, cut) = chosen[k], kinds[k]
                            labels += e[0]
                            cost += {"D": 2, "K": 0, "R": 1}[e[0]] + (5 * cut if e != "D" else 0)
                            roles += {"D": "", "K": initial or "?", "R": e[1:]}[e[0]]
                    if GRAMMAR.fullmatch(roles) and (best is None or (cost, labels) < best):
                        best = cost, labels
    return best


def plain(kinds):
    """Least (cost, labels) by uniform-cost search over (row, state), with the labels themselves in the queue."""
    queue, done = [(0, "", 0, 0)], set()
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    while queue:
        cost, labels, row, state = heapq.heappop(queue)
        if (row, state, labels) in done or row > len(kinds):
            continue
        done.add((row, state, labels))
        if row == len(kinds) and state in (0, 3):
            return cost, labels
        for role in "ua":
            if (state, role) in step and not labels.endswith("III"):
                heapq.heappush(queue, (cost + 5, labels + "I", row, step[state, role]))
        if row < len(kinds):
            initial, gone, cut = kinds[row]
            heapq.heappush(queue, (cost + 2, labels + "D", row + 1, state))
            if not gone:
                if (state, initial) in step:
                    heapq.heappush(queue, (cost + 5 * cut, labels + "K", row + 1, step[state, initial]))
                for role in "ua":
                    if (state, role) in step:
                        heapq.heappush(queue, (cost + 1 + 5 * cut, labels + "R", row + 1, step[state, role]))


def random_kinds(r, n):
    out = []
    for _ in range(n):
        gone = r.random() < 0.2
        out.append((r.choice(["s", "u", "a", "u", "a", ""]), gone, not gone and r.random() < 0.3))
    return out


def test_cheapest_against_every_edit_sequence():
    r = random.Random(1)
    for n in (0, 1, 2, 3):
        for _ in range(12):
            kinds = random_kinds(r, n)
            assert C.cheapest(kinds) == exhaustive(kinds, 3), kinds
            assert C.cheapest(kinds) == plain(kinds)


def test_cheapest_against_uniform_cost_search():
    r = random.Random(2)
    for _ in range(250):
        kinds = random_kinds(r, r.randint(4, 9))
        assert C.cheapest(kinds) == plain(kinds), kinds


def brute(rows, ids):
    """Reports by the definition."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv in ids:
        there = sorted(by[conv], key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), xxhash.xxh64_intdigest(x[2].encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(x[2].encode(), 42) >> 63)))
        kinds, seen, faults = [], set(), collections.Counter()
        for _, role, text in there:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            kinds.append((role[:1] if role[:1] in "sua" else "", fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(there, there[1:]))
        turns = [t for t, _, _ in there if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = C.cheapest(kinds)
        out, state, k = [], 0, 0
        for e in audit:
            if e != "D":
                role = there[k][1] if e == "K" else ("user" if state != 2 else "assistant")
                state = {"s": 1, "u": 2, "a": 3}[role[:1]]
                out.append(f"{role}:{'' if e == 'I' else there[k][2]}")
            k += e != "I"
        yield conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def got(frame):
    return collections.Counter((r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect())


def conversations(n=60, seed=3):
    r = random.Random(seed)
    texts = ["Hi.", "Why?", "", " \n", "cut off", "So é!", "Long " * 3000 + "end.", "same.", "same."]
    rows = []
    for conv in [None, *range(n)]:
        turn = 0
        for _ in range(r.choice([1, 2, 4, 6, 9, 30])):
            turn += r.choice([0, 1, 1, 1, 3])
            rows.append((conv, r.choice([turn, turn, turn, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice([*texts, f"t{len(rows)}.", None])))
    rows += rows[5:9]
    return [(*x, "clash", 1) for x in rows]


@pytest.mark.parametrize("piece_rows", [4096, 3])
def test_reports_and_turns_against_brute_force(spark, piece_rows):
    rows = conversations()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = C.repair(frame, keep_turns=True, piece_rows=piece_rows)
    want = collections.Counter(brute([x[:4] for x in rows], {x[0] for x in rows}))
    assert got(found.report) == want
    texts = collections.defaultdict(list)
    for t in sorted(found.turns.collect(), key=lambda t: (t.piece, t.place)):
        texts[t.conv_id].append(f"{t.role}:{t.text}")
    digests = {r[0]: r[8] for r in want}
    assert all(hashlib.sha256("\n".join(texts[c]).encode()).hexdigest() == d for c, d in digests.items())
    assert got(C.repair(frame.limit(0), piece_rows=piece_rows).report) == {}


def test_one_long_conversation_in_many_pieces(spark):
    """A conversation with most rows, with one row repeated often and duplicates far apart, over several parts and pieces."""
    r = random.Random(9)
    rows = [(7, k, r.choice(["user", "assistant"]), f"text {k % 900}." if k % 11 else "no end") for k in range(3000)] + [(7, 50, "user", "again.")] * 400 + [(c, 0, "user", "q?") for c in range(20)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert got(C.repair(frame, piece_rows=100).report) == collections.Counter(brute(rows, {x[0] for x in rows}))


def damaged(rows):
    """The contract's damage, row by row."""
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        for _ in range(0 if k == 0 else 2 if k == 3 else 1):
            yield conv, turn, "user" if k == 4 else role, text


def test_query_against_brute_force(spark, tmp_path):
    import pyarrow.parquet as pq

    from tests.conftest import SF

    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    assert got(queries.op12_conversation_repair(spark, SF)) == collections.Counter(brute(list(damaged(rows)), {x[0] for x in rows}))
    odd = [*conversations(seed=5), *[(900 + k, k, "user", "Gone?", "x", 0) for k in range(60)]]
    spark.createDataFrame(odd, SCHEMA).write.parquet(f"{tmp_path}/a/conversations.parquet")
    want = collections.Counter(brute(list(damaged(x[:4] for x in odd)), {x[0] for x in odd}))
    assert got(queries.op12_conversation_repair(spark, f"{tmp_path}/a")) == want and any(x[7] == "" for x in want)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert queries.op12_conversation_repair(spark, f"{tmp_path}/b").count() == 0
