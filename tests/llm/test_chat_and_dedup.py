import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyarrow import fs as pafs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.llm import chat_format as cf
from lexispark.llm import exact_dedup as ed

hostile = st.lists(st.sampled_from(["<", "|", "\\", "<|", "<\\|", "im_end", "|>", cf.START, cf.END, "\n", "assistant", "a", "n", "é"]), max_size=9).map("".join)


@given(st.lists(st.tuples(hostile, hostile), max_size=5))
@settings(max_examples=300, deadline=None)
def test_round_trip(turns):
    assert cf.parse("".join(cf.render(r, t)[0] for r, t in turns)) == turns
    for role, text in turns:
        formatted, first, end = cf.render(role, text)
        assert cf.unescape(formatted[first:end]) == text


def test_chats(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", cf.HOSTILE, "x" * 50, "é\n"]), "clash") for c in [*range(20), None] for t in [*range(rng.randrange(1, 9)), None]]
    rows += [(1, 2, "assistant", "again", ""), (1, 2, "assistant", "again", ""), (77, 0, "user", "only", "")] + [(88, t, ("user", "assistant")[t % 2], f"t{t}", "") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string")
    chats = defaultdict(list)
    for c, t, r, x, _ in rows:
        chats[c].append((t is not None, t or 0, r or "", x or ""))
    examples = cf.format_chats(df)
    got = {r.conv_id: r for r in cf.read_back(examples).collect()}
    assert got.keys() == chats.keys()
    for c, turns in chats.items():
        turns.sort()
        loss = [x for *_, r, x in turns if r == "assistant"]
        assert got[c].n_turns == len(turns) and got[c].n_examples == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert got[c].loss_chars == len("".join(loss)) and got[c].loss_sha256 == hashlib.sha256("".join(loss).encode()).hexdigest()
    one = examples.where("conv_id = 88 and example = 2").first()
    assert cf.parse(one.text) == [(("user", "assistant")[t % 2], f"t{t}") for t in range(6)] and one.text[one.loss_start : one.loss_end] == "t5"
    assert cf.read_back(cf.format_chats(df.limit(0))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5, 3000])
def test_minimal_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 2**63, (n, 4)).astype(np.uint64)
    assert sorted(ed.MinimalPerfectHash.build(keys).slots(keys).tolist()) == list(range(n))
    segment = ed.Segment.load(ed.Segment.build(keys, [None if i % 7 == 0 else i for i in range(n)], list(range(n))).dump())
    slots = segment.find(keys)
    assert (segment.digests[slots] == keys).all() and segment.counts[slots].tolist() == list(range(n))
    near = keys.copy()
    near[:, 3] ^= np.uint64(1)
    assert (segment.find(near) == -1).all()


def test_dedup(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a b", " a b", "long " * 50_000]
    rows = [(i, rng.choice(texts), "clash") for i in range(80)] + [(3, "dup", ""), (3, "dup", ""), (None, "dup", ""), (None, "nobody", ""), (None, "nobody", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    plain = defaultdict(list)
    normal = lambda t: re.sub("[\x20\x09-\x0D]+", " ", t or "")
    for i, t, _ in rows:
        plain[normal(t)].append(i)
    expected = sorted(((i is None, i or 0), min((x for x in plain[normal(t)] if x is not None), default=-1), len(plain[normal(t)])) for i, t, _ in rows)
    digests = ed.digests_of(df)
    order = lambda out: sorted(((r.doc_id is None, r.doc_id or 0), -1 if r.keep_id is None else r.keep_id, r.group_size) for r in out)
    whole = ed.deduplicate(digests, ed.build_index(digests, segment_keys=3)).collect()
    assert order(whole) == expected and all(r.member for r in whole)
    assert sum(r.kept for r in whole) == len(plain)
    nothing = ed.deduplicate(digests, ed.build_index(digests.limit(0))).collect()
    assert order(nothing) == expected and not any(r.member for r in nothing) and sum(r.kept for r in nothing) == len(plain)
    history = digests.where(F.col("doc_id") < 40)
    later = ed.deduplicate(digests.where(F.col("doc_id") >= 40), ed.build_index(history)).collect()
    assert all(not r.kept and r.keep_id < 40 for r in later if r.member)
    assert ed.deduplicate(digests.limit(0), ed.build_index(history)).count() == 0


def test_lost_segment_is_an_error(spark):
    digests = ed.digests_of(spark.createDataFrame([(i, f"text {i % 50}") for i in range(100)], "doc_id long, text string"))
    index = ed.build_index(digests, segment_keys=2)
    files, path = pafs.FileSystem.from_uri(index.folder)
    found = sorted(f.path for f in files.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".mph"))
    assert len(found) == index.segments == 25
    files.delete_file(found[3])
    with pytest.raises(Exception, match="mph"):
        ed.deduplicate(digests, index).collect()


def test_large_group_of_copies(spark, monkeypatch):
    """A group with more than its share of rows is dealt over several pieces; members and strangers get the same result."""
    monkeypatch.setattr(ed, "PIECE_ROWS", 8)
    rows = [(i, "same text" if i % 3 else f"other {i}") for i in range(150)] + [(None, "same text"), (4, "same text")]
    digests = ed.digests_of(spark.createDataFrame(rows, "doc_id long, text string"))
    for history in (digests, digests.limit(0)):
        got = ed.deduplicate(digests, ed.build_index(history)).collect()
        same = [r for r in got if r.group_size > 1]
        assert len(got) == len(rows) and len(same) == 102 and {(r.keep_id, r.group_size) for r in same} == {(1, 102)}
        assert [r.doc_id for r in same if r.kept] == [1] and sum(r.kept for r in got) == 51
