"""Random strings are found wherever they lie in runs of any length; known forms and ordinary runs stay."""

import random
import string
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.llm import secrets

BASE62 = string.ascii_letters + string.digits
WORDS = "connection string handler service production database user profile settings account".split()


def joined(rng, size, between=""):
    """Words to about a size, with nothing or a separator between them."""
    out = ""
    while len(out) < size:
        out += rng.choice(WORDS) + between
    return out[:size]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 20_000), st.integers(0, 10_000), st.sampled_from(["", "_", "/"]))
def test_found_at_every_place_of_a_long_run(at, seed, between):
    rng = random.Random(seed)
    secret = "".join(rng.choices(BASE62, k=40))
    run = joined(rng, 20_000, between)
    out = secrets.without_secrets(f"see {run[:at]}{secret}{run[at:]} end")
    assert not any(secret[k : k + 12] in out for k in range(0, 29, 7))
    assert len(out) > 19_000


@pytest.mark.parametrize("border", [4096, 8192])
def test_borders_of_what_is_encoded_at_once(border):
    rng = random.Random(border)
    left = 0
    for k in range(60):
        secret = "".join(rng.choices(BASE62, k=26))
        run = joined(rng, 20_000, "")
        at = border - k % 27
        left += secret in secrets.without_secrets(run[:at] + secret + run[at:])
    assert left <= 2


def test_best_stretch_is_the_maximum_over_all():
    rng = np.random.default_rng(5)
    for _ in range(200):
        sizes = rng.integers(1, 8, rng.integers(1, 60))
        ends, score = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(2.0 - sizes))
        every = [(score[j] - score[i], i, j) for i in range(len(ends)) for j in range(i, len(ends)) if ends[j] - ends[i] >= secrets.MIN_RUN]
        most = max((x[0] for x in every), default=0.0)
        found = secrets._best(ends, score, 0, len(ends) - 1)
        assert (found is None) == (most <= 0)
        if found:
            assert score[found[1]] - score[found[0]] == pytest.approx(most) and ends[found[1]] - ends[found[0]] >= secrets.MIN_RUN
            assert max(score[j] - score[i] for i, j in secrets._stretches(ends, score)) == pytest.approx(most)


def test_no_dense_stretch_is_left():
    """Outside the found stretches no stretch of enough characters has a positive score."""
    rng = np.random.default_rng(6)
    for _ in range(200):
        sizes = rng.choice([1, 1, 2, 3, 6, 9], rng.integers(1, 150))
        ends, score = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(2.0 - sizes))
        covered = np.zeros(len(sizes), bool)
        for i, j in secrets._stretches(ends, score):
            covered[i:j] = True
        free = np.flatnonzero(~covered)
        for part in np.split(free, np.flatnonzero(np.diff(free) > 1) + 1):
            if len(part):
                assert secrets._best(ends, score, int(part[0]), int(part[-1]) + 1) is None


def test_known_forms_stay():
    for t in (
        "2024-01-05T10-22-33_run_17", "backup/20240105T102233Z/part-17", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "logs/2024-01-05T10-22/host-3",
    ):
        assert secrets.without_secrets(f"see {t} end") == f"see {t} end"


def test_many_secrets_in_one_run_take_little_time():
    rng = random.Random(8)
    parts = []
    for _ in range(3_000):
        parts += [joined(rng, rng.randrange(20, 200), "_"), "".join(rng.choices(BASE62, k=rng.randrange(24, 60)))]
    began = time.perf_counter()
    out = secrets.without_secrets("_".join(parts))
    assert time.perf_counter() - began < 20
    assert sum(p in out for p in parts[1::2]) <= 3
