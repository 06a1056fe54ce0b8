"""The prefix trie against plain Python, over one and many ranges."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, sid string, part int, path string"


def plain_turns(rows):
    def key(role, text):
        return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()

    found = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            found[conv_id].append((turn is not None, turn or 0, key(role, text)[:16], (role or "", text or "")))
    return {c: tuple(x[3] for x in sorted(turns)) for c, turns in found.items()}


def plain_rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, ())[:h] + own[h:]
    return out


def plain_trie(turns):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in sorted(turns.items()):
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())
        for p, m in members.items()
    )


def rows_of(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(*names).collect())


def conversations(rng, n):
    words = ["yes", "no", "Grüße", "", None, "long text " * 30, "日本"]
    rows = []
    for c in rng.sample(range(-300, 900), n):
        hot = rng.random() < 0.4
        turns = range(40 if c % 97 == 0 else rng.randrange(1, 9))
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot"]) if not hot else "user", "same" if hot and t < 6 else rng.choice(words)) for t in turns]
    rows += [rows[0], rows[0], (None, 1, "user", "no conversation"), (5000, None, None, None), (6000, 2, "a", "1:x"), (6000, 2, "a1", ":x")]
    return rows


@pytest.mark.parametrize("range_bytes", [1 << 24, 600])
def test_equals_plain_trie(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(trie, "RANGE_BYTES", range_bytes)
    rows = conversations(random.Random(range_bytes), 160)
    table = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(5)
    arrays = trie.turn_arrays(table)
    turns = plain_turns(rows)
    assert {r["conv_id"]: len(r["turns"]) for r in arrays.collect()} == {c: len(t) for c, t in turns.items()}
    assert rows_of(trie.prefix_trie(arrays)) == plain_trie(turns)
    assert rows_of(trie.prefix_trie(trie.with_base_turns(arrays))) == plain_trie(plain_rebuilt(turns))


def test_copies_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "RANGE_BYTES", 2_000)
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    rows += [(1000, t, "user", f"turn {t}") for t in range(3_000)] + [(1001, t, "user", f"turn {t if t < 2_000 else -t}") for t in range(2_500)]
    got = rows_of(trie.prefix_trie(trie.turn_arrays(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    assert len(got) == 3_000 + 500 + 1
    root = next(r for r in got if r[1] == 0)
    assert root[3:6] == (302, 1, 2)
    third = next(r for r in got if r[1] == 3)
    assert third[3] == 302 and third[7] == hashlib.sha256(",".join(map(str, range(300))).encode()).hexdigest()
    shared = sum(len(f"turn {t}") for t in range(3)) * 301 + sum(len(f"turn {t}") for t in range(3, 2_000))
    assert root[6] == shared


def test_empty_table(spark):
    assert trie.prefix_trie(trie.with_base_turns(trie.turn_arrays(spark.createDataFrame([], SCHEMA)))).count() == 0


_STRINGS = st.lists(st.lists(st.sampled_from([b"a" * 16, b"a" * 15 + b"b", b"c" * 16]), max_size=5).map(b"".join), max_size=30, unique=True)


@settings(max_examples=200, deadline=None)
@given(_STRINGS, st.integers(1, 7))
def test_loser_tree_gives_order_and_shared_turns(strings, k):
    runs = []
    for r in range(k):
        own = sorted(strings[r::k])
        runs.append((own, [0, *(trie.shared_turns(a, b) for a, b in zip(own, own[1:], strict=False))][: len(own)]))
    runs = [r for r in runs if r[0]]
    got = [(runs[r][0][i], lcp) for r, i, lcp in trie.merged(runs)]
    whole = sorted(strings)
    assert [g for g, _ in got] == whole
    assert [lcp for _, lcp in got] == [0, *(trie.shared_turns(a, b) for a, b in zip(whole, whole[1:], strict=False))][: len(whole)]
