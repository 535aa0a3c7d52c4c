import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import prefix_trie as pt
from lexispark.llm.shared import new_folder

paths = st.lists(st.lists(st.sampled_from("abc"), max_size=6).map("".join), min_size=1, max_size=40)
wide = lambda path: "".join(path).encode().ljust(0) if not path else b"".join(c.encode() * pt.WIDTH for c in path)


def trunc_mod(c, n):
    return c - int(c / n) * n if abs(c) < 2**50 else (c % n if c >= 0 else -(-c % n))


def plain_trie(rows):
    """All nodes by their prefixes."""
    chats = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            chats[c].append((t is not None, t or 0, digest, role, text))
    chats = {c: [x[3:] for x in sorted(turns)] for c, turns in chats.items()}
    rebuilt = {}
    for c, own in chats.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(chats.get(c - trunc_mod(c, 5), [])[:h] + own[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(rebuilt):
        path = rebuilt[c]
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
    own_saved = {p: (len(m) - 1) * (len(p[-1][1].encode()) if p else 0) for p, m in members.items()}
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own_saved[p]
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in list(members.items()))


def got(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(*pt.NODES_OF).collect())


@given(st.binary(max_size=6), st.binary(max_size=6), st.binary(max_size=6))
@settings(max_examples=200, deadline=None)
def test_shared_turns(head, x, y):
    a, b = ((b"".join(bytes([c]) * pt.WIDTH for c in part)) for part in (head + x, head + y))
    common = 0
    while common < min(len(head + x), len(head + y)) and (head + x)[common] == (head + y)[common]:
        common += 1
    assert all(pt.shared_turns(a, b, at) == common for at in range(len(head) + 1))


@given(paths, st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_merge_of_runs(texts, n_runs):
    rows = [(wide(p), i, b"") for i, p in enumerate(texts)]
    runs = [iter(pt.sorted_run(rows[i::n_runs])) for i in range(n_runs)]
    tree = pt.LoserTree(runs)
    assert list(tree) == pt.sorted_run(list(rows))
    # No shared turn is compared again: each comparison looks at one turn more than it learns.
    assert tree.compared <= sum(len(p) // pt.WIDTH for p, *_ in rows) + len(rows) * (2 + n_runs.bit_length())


def test_runs_on_disk(spark):
    rng = random.Random(1)
    rows = [(wide("".join(rng.choices("ab", k=rng.randrange(9)))), i, b"12345678") for i in range(700)]
    runs = pt.Runs(new_folder(spark, "runs"), run_bytes=2000, fan_in=3)
    for row in rows:
        runs.add(*row)
    assert len(runs.written) > 27
    assert list(runs.merged()) == pt.sorted_run(rows)
    assert not runs.files.get_file_info(pt.pafs.FileSelector(runs.path))


def conversations(seed, n=150, heavy=False):
    rng = random.Random(seed)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", None, ""]))
    rows = [(c, t, *say()) for c in [*range(-20, n), 10**15, -(2**63) + 3] for t in range(rng.choice([1, 2, 3, 9, 12]))]
    rows += [(c, None, "user", "first") for c in range(0, n, 7)] + [(3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, "user", "tie 2"), (None, 0, "user", "nobody")]
    rows += [(5, t, "user", f"turn {t % 3}") for t in range(100, 600)] + [(11, 0, "assistant", "long " * 100_000)]
    if heavy:
        rows += [(c, t, "user", "same") for c in range(1000, 1400) for t in range(4)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "heavy", "more"), [(1, False, {}), (2, True, {"part_bytes": 3000, "run_bytes": 1500, "fan_in": 2, "block": 5}), (3, True, {"part_bytes": 60_000, "run_bytes": 4000, "block": 3})])
def test_equals_brute_force(spark, monkeypatch, seed, heavy, more):
    rows = conversations(seed, heavy=heavy)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, path string")
    assert got(pt.prefix_trie(df, **more)) == plain_trie(rows)


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert got(pt.prefix_trie(df)) == []
    turnless = [(6, 0, "user", "x")]
    df = spark.createDataFrame(turnless, "conv_id long, turn long, role string, text string")
    assert got(pt.prefix_trie(df)) == plain_trie(turnless)
