"""Random strings joined to words, around hexadecimal runs, and of letters only."""

import random
import string

from ravelin.llm import secrets

BASE62 = string.ascii_letters + string.digits


def redacted(text, secret):
    return secret not in secrets.without_secrets(text)


def test_joined_secrets():
    rng = random.Random(23)
    for before in ("", "callback_signature=", "services/production/database/connection=", "some_long-config/path+to/"):
        for after in ("", "/and/other/words/that/follow", "_suffix"):
            for size in (20, 24, 32, 40):
                made = ["".join(rng.choices(BASE62, k=size)) for _ in range(60)]
                assert sum(redacted(f"see {before}{s}{after} end", s) for s in made) >= 59


def test_secrets_with_separators():
    rng = random.Random(29)
    made = ["".join(rng.choices(BASE62 + "+/", k=64)) for _ in range(60)]
    left = [secrets.without_secrets(f"see services/production/database/connection={s} end") for s in made]
    assert sum(not any(len(p) > 8 and p in out for p in s.replace("+", "/").split("/")) for s, out in zip(made, left, strict=True)) >= 58


def test_rest_around_a_hex_run():
    rng = random.Random(31)
    for _ in range(40):
        s = "".join(rng.choices(BASE62, k=30))
        assert redacted(f"{s}_{'0123456789ab' * 2}_{s[::-1]}", s)


def test_letters_only():
    rng = random.Random(37)
    made = ["".join(rng.choices(string.ascii_letters, k=32)) for _ in range(60)]
    assert sum(redacted(f"key {s} end", s) for s in made) >= 59


def test_identifiers_stay():
    for t in (
        "services/production/database/connection_string_number_12",
        "Rechtsschutzversicherungsgesellschaften and antidisestablishmentarianism",
        "users/123e4567-e89b-12d3-a456-426614174000/profile/settings",
        "2024-01-15/2024-02-17/2024-03-19",
        "com/example/internal/service/AbstractFactoryBuilderImplementation2",
        "-" * 60 + "=" * 60,
    ):
        assert secrets.without_secrets(t) == t
