"""The conversation trie against one that is built from whole texts."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from evidentia.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def brute(turns, head):
    own = {}
    for c, _, role, text in sorted((t for t in turns if t[0] is not None), key=lambda t: (t[0], t[1] is not None, t[1] or 0, t[2] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {}
    for c, xs in own.items():
        h = head(c)
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + xs[h:])
    members = {}
    for c, xs in rebuilt.items():
        for d in range(len(xs) + 1):
            members.setdefault(xs[:d], []).append(c)
    out = []
    for key, cs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(j) == len(k) + 1 and j[: len(k)] == k for j in members)]
        saved = sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        ends = ",".join(str(c) for c in sorted(cs) if rebuilt[c] == key)
        parent = min(members[key[:-1]]) if key else None
        out.append((min(cs), len(key), parent, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def crc_head(c):
    return zlib.crc32(str(c).encode()) % 4


def found(spark, turns, head=None, **more):
    df = spark.createDataFrame(turns, TURNS)
    got = prefix_trie.prefix_trie(df, prefix_trie.base_rule(), prefix_trie.head_rule() if head is None else head, **more)
    return got, sorted((tuple(r)[:8] for r in got.collect()), key=repr)


def made(seed, convs=90):
    rng = random.Random(seed)
    turns = []
    for c in rng.sample(range(-20, 200), convs):
        for i in range(rng.choice([0, 1, 2, 3, 5, 9])):
            turns.append((c, rng.choice([i, i, 3 * i]) if rng.random() < 0.95 else None, f"r{i}", rng.choice(["a b", "c", "", None, " x  y z "])))
    seen, out = set(), []
    for t in turns:  # one row a number and conversation: ties have a test of their own
        if (t[0], t[1]) not in seen:
            seen.add((t[0], t[1]))
            out.append(t)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    turns = made(seed)
    assert found(spark, turns)[1] == brute(turns, crc_head)


def test_odd_rows(spark):
    turns = [
        (0, None, None, None), (0, 0, "u", ""), (0, 0, "u", ""), (0, 5, "u", "word " * 60_000),
        (7, 1, "u", "own"), (27, 1, "u", "no base"), (40, 1, "u", "x"), (41, 1, "u", "x"), (42, 1, "u", "x"), (None, 1, "u", "nobody"), (-3, 1, "a", None), (-3, 2, "u", None), (-3, 2, "a", None),
    ]
    assert found(spark, turns)[1] == brute(turns, crc_head)
    df = spark.createDataFrame(turns, TURNS).withColumns({c: F.lit(1) for c in ("row", "part", "pos", "h1", "k", "words", "depth")})
    again = prefix_trie.prefix_trie(df, prefix_trie.base_rule(), prefix_trie.head_rule())
    assert sorted((tuple(r)[:8] for r in again.collect()), key=repr) == brute(turns, crc_head)


def test_empty_table(spark):
    assert found(spark, [])[1] == []


def test_one_conversation_over_many_tasks(spark):
    turns = [(1, i, "u", f"t{i % 7}") for i in range(700)] + [(2, i, "u", f"t{i % 7}") for i in range(300)] + [(3, 0, "u", "t0")]
    got = found(spark, turns, head=F.lit(0))[1]
    assert got == brute(turns, lambda c: 0)


def test_references_hold_the_last_turn(spark):
    turns = made(3)
    got, _ = found(spark, turns)
    order = sorted((t for t in turns if t[0] is not None), key=lambda t: (t[0], t[1] is not None, t[1] or 0))
    own = {}
    for t in order:
        own.setdefault(t[0], []).append((t[2] or "", t[3] or ""))
    for r in got.collect():
        if r["depth"]:
            c, h = r["conv_id"], crc_head(r["conv_id"])
            whole = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
            assert own[r["turn_conv_id"]][r["turn_pos"] - 1] == whole[r["depth"] - 1]


def test_collisions_are_seen_and_drawn_anew(spark):
    turns = made(4)
    with pytest.raises(RuntimeError):
        found(spark, turns, tries=2, prime=5)
    assert found(spark, turns, tries=12, prime=11)[1] == brute(turns, crc_head)


def test_head_out_of_range_fails(spark):
    with pytest.raises(Exception, match="a head has"):
        found(spark, [(1, 0, "u", "x")], head=F.lit(4))[0].collect()
